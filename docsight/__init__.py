"""docsight: retrieval and text analytics over large document collections, as Spark DataFrame plans."""

__version__ = "0.1.0"
