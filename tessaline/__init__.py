"""Feature discovery on Spark DataFrames: every feature is a Catalyst expression with frozen statistics."""
