"""quarry: retrieval-augmented generation as Spark DataFrame plans."""

__version__ = "0.1.0"
