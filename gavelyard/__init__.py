"""A PySpark-native engine for public auction notices and text corpora."""
