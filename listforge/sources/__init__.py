"""Reading pages, feeds, messages and tables into DataFrames."""
