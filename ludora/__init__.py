"""ludora: game and review analytics on Spark DataFrames."""
