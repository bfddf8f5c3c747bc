"""causeway: causal analytics on Spark DataFrames, with tools for training-data corpora in ``causeway.llm``."""
