"""bitloom: bilevel document analytics on Spark DataFrames."""
