"""Portfolio exposure analytics on Spark: a library of DataFrame operators."""
