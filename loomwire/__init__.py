"""loomwire: a PySpark-native engine for topical digests from web and feed content."""
