"""Pipeline observability as DataFrame operators on Spark."""
