"""lexmill: curation and evaluation of text corpora on Spark DataFrames."""
