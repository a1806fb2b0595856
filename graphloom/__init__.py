"""Evidence graphs, retrieval and composition on Spark DataFrames."""
