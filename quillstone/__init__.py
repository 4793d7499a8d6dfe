"""Document-corpus and retrieval analytics as Spark plans: DataFrames in, DataFrames out."""
