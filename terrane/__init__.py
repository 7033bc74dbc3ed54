"""terrane: feature analytics and corpus preparation on Spark DataFrames."""
