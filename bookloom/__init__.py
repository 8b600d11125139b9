"""Corpus cleaning and book-structure analytics on Spark DataFrames."""
