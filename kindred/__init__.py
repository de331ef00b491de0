"""kindred: cohort-genetics analytics as Spark DataFrame jobs."""
