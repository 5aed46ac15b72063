"""A Spark-native engine for trending and monitoring many time-series channels."""
