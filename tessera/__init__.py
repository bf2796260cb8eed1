"""tessera: a Spark-native engine for content-addressed file archives."""

__version__ = "0.1.0"
