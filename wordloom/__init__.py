"""A Spark-native engine for directed word graphs."""
