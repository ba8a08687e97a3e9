"""Long-read transcript analytics on Spark DataFrames."""
