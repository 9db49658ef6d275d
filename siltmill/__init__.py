"""A Spark-native engine for refining, auditing and packaging text corpora."""
