"""kinmap: dataset-similarity analytics on Spark DataFrames."""
