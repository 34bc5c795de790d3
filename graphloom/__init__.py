"""graphloom: graph-augmented retrieval and corpus analytics on Spark DataFrames."""
