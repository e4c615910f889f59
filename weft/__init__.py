"""weft: declarative data harmonisation on Spark DataFrames."""
