"""A relational query and data-access engine on Spark DataFrames."""
