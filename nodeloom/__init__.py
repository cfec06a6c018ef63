"""A Spark-native document-node ingestion and catalog engine."""
