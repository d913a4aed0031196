"""A Spark-native engine for lineage graphs, text matching and corpus preparation."""
