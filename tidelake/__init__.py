"""Market and brokerage data on a bronze, silver and gold lakehouse, as Spark DataFrame operators."""
