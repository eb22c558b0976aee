"""Citation analytics for encyclopedia dumps, written as Spark DataFrame operators."""

__version__ = "0.1.0"
