"""Text-corpus and hybrid-retrieval analytics on Spark DataFrames."""
