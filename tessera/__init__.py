"""A Spark-native engine for a Postgres-flavoured SQL dialect."""
