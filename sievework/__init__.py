"""A PySpark-native engine for turning loose records into a queryable corpus."""
