"""Document analytics, risk scoring and knowledge graphs as Spark DataFrame operators."""
