"""recollect: analytics over long-lived memory data, as plain Spark DataFrame operators."""
