"""kelpworks: code and document retrieval as Spark DataFrame programs."""

__version__ = "0.1.0"
