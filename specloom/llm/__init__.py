"""Training-data operators (deduplication, filtering, scoring, mixing, search) on Spark DataFrames."""
