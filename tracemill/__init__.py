"""Analytics of agents' traces on Spark: normalising, planning, scoring, reporting, retrieval."""
