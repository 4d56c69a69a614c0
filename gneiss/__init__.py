"""A PySpark-native analytics engine for forensic and content data."""
