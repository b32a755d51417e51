"""A Spark-native engine for compositional text tokenization and its data preparation."""
