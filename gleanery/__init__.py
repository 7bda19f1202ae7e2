"""gleanery: a PySpark-native engine for evidence capture, enrichment, retrieval and read-models."""

__version__ = "0.1.0"
