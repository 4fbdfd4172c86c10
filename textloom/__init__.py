"""textloom: a Spark-native engine for indexing and searching text and code corpora."""
