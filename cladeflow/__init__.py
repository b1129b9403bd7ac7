"""A PySpark-native analytics engine for marker-sequence occurrence data."""
