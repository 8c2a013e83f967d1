"""codeweft: a Spark-first analytics engine for source code treated as relational data."""

__version__ = "0.1.0"
