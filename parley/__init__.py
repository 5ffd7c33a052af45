"""Meeting analytics as Spark DataFrame jobs."""
