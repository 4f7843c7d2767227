"""A Spark-native engine for corpora of source code and documents."""
