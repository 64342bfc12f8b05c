"""Lending and circulation analytics on Spark DataFrames."""
