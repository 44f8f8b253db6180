"""Retrieval analytics over corpora, questions and entity graphs as Spark DataFrames."""
