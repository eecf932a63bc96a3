"""Standing single-table queries over change streams, on Spark."""
