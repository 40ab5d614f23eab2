"""Document intelligence and device analytics as Spark DataFrame operators."""
