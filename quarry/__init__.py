"""quarry: a PySpark-native engine that turns web pages into a searchable knowledge base."""

__version__ = "0.1.0"
