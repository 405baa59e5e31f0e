"""Document reading analytics on Spark: typed, traceable regions, sentences and speech chunks."""
