"""A Spark-native engine for document corpora: cleaning, chunking, dedup, retrieval, evaluation, dialogue, assessment."""
