"""cuespark: a Spark-first engine for timed-text (subtitle) data sets."""

__version__ = "0.1.0"
