"""Note collections on Spark: fragments, keyword and vector search, hybrid ranking, roll-ups, reviews."""
