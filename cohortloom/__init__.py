"""cohortloom: credit-cohort features and outcomes as Spark DataFrame jobs."""
