"""postmere: a PySpark-native engine for mail and document archives."""

__version__ = "0.1.0"
