"""tessera: a PySpark-native analytics engine for message archives."""

__version__ = "0.1.0"
