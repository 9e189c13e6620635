"""A PySpark-native engine for document translation dataflows and for the preparation of large text corpora."""
