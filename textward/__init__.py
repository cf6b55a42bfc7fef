"""Text guard engine on Spark DataFrames."""
