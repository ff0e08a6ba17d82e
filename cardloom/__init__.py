"""Card-network economics, merchant graphs and training-corpus operators as Spark DataFrames."""
