"""Corpus analytics on Spark: concordances, collocates, frequencies and tagging over plain DataFrames."""
