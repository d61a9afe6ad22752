"""textmill: a PySpark-native analytics engine for long-document corpora."""
