"""Table-extraction analytics on Spark: scoring, roll-ups, cost, reliability."""
