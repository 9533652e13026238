"""The registered queries: driver tables seen as credit tables, Spark jobs, oracle SQL."""
