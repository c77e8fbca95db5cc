"""A Spark-native engine for retrieval over, and refresh of, a document corpus."""
