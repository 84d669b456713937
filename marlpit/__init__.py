"""Decision-data analytics on Spark: DataFrame operators for building and auditing decision benchmarks."""
