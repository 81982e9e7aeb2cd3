"""Weft: directed B-hypergraph analytics and training-data operators on Spark DataFrames."""
