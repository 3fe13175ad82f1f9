"""Spark-native engine that turns collected web text into a traceable, searchable question library."""

__version__ = "0.2.0"
