"""Document sampling, coding, agreement and text-classification analytics on Spark DataFrames."""
