"""A Spark-native analytics library: star-schema queries, text and web-log analysis, incremental twins."""
