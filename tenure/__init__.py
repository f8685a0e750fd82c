"""A PySpark-native engine for property-ownership data; see README.md."""
