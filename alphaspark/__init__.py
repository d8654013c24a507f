"""A PySpark-native engine for factor research over panels of bars."""
