"""routewise: marketplace delivery analytics on Spark DataFrames."""
