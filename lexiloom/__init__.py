"""lexiloom: prose analytics on Spark DataFrames."""
