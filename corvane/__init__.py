"""corvane: a PySpark-native engine for a corpus of named, tagged concepts."""

__version__ = "0.1.0"
