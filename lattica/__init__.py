"""A PySpark-native analytics engine for tabular and document data."""
