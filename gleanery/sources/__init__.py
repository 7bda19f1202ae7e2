from gleanery.sources.tables import table, table_names

__all__ = ["table", "table_names"]
