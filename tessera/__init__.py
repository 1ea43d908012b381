"""tessera: a Spark-first analytics engine for code graphs and fielded retrieval."""
