"""bookloom: a Spark-native engine for paginated books, narration scripts and their quality checks."""
