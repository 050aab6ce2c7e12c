"""Order-flow and table-processing engine on Spark DataFrames."""
