"""Station-availability analytics as Spark DataFrame operators."""
