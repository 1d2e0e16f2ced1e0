"""sievework: typed decisions over text and the corpus work around them, as Spark DataFrame operators."""

__version__ = "0.1.0"
