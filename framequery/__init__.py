"""Frame retrieval, ranking evaluation and corpus building on Spark DataFrames."""
