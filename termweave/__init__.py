"""termweave: terminology linking, similarity mining and evaluation on Spark DataFrames."""
