"""Purchase-propensity analytics as Spark DataFrame operators."""
