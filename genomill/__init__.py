"""A PySpark-native analytics engine for genetic variant data."""
