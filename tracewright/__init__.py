"""tracewright: human-mobility analytics as composable PySpark DataFrame operators."""
