"""Analytics for dyadic and hierarchical data on Spark DataFrames."""
