"""Lodestone: document retrieval and requirement analytics on Spark DataFrames."""
