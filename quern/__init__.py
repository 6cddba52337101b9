"""A PySpark-native engine for a compact, strictly typed SQL fragment."""
