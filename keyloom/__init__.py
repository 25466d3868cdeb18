"""Product-page keyword analytics on Spark: pages, facts, keyword rows, selection, validation and quality as DataFrames."""
