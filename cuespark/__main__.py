import sys

from cuespark.cli import main

sys.exit(main())
