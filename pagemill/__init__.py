"""pagemill: web-page and corpus processing on Spark DataFrames."""
