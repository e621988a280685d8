"""pressleaf: a Spark-first engine for analysing and archiving web pages in bulk."""
