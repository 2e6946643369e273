"""A PySpark-native engine for source-target visibility analytics."""
