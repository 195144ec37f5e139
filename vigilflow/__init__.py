"""vigilflow: a Spark-native analytics engine for security-news streams."""
