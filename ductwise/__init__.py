"""A PySpark-native engine for planning and analysing utility networks."""
