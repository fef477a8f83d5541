"""A Spark-native clinical analytics engine."""
