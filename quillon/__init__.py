"""quillon: a PySpark-native engine for querying, comparing and auditing keyed records and texts."""

__version__ = "0.1.0"
