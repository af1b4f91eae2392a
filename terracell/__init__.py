"""terracell: gridded indicators and administrative statistics as Spark DataFrames."""
