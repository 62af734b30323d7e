"""grainfold: a semantic analytics engine written as PySpark plans."""

__version__ = "0.1.0"
