"""tidewater: a Spark-first analytics engine with a transactional table layer."""
