"""Mail-threat analytics as Spark DataFrame operators."""
