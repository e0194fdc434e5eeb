"""Controls, line and paragraph separators, and marks that change the direction of text."""

import re

UNSAFE = "[\\x00-\\x1F\\x7F-\\x9F\\u061C\\u200E\\u200F\\u2028-\\u202E\\u2066-\\u206F]"
UNSAFE_CHARACTERS = re.compile(UNSAFE)
