"""quirespark: Spark-first analytics over page objects, text lines and multi-document text."""

__version__ = "0.1.0"
