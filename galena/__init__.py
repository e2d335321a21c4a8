"""A Spark-native engine for event-time observability analytics."""
