"""Reading tables into DataFrames and writing results out."""
