"""Event knowledge from dependency-parsed text, as Spark DataFrames."""
