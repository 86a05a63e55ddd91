"""A document-analytics and retrieval engine on Spark DataFrames."""
