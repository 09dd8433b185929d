"""The declarative query model and its compilation to DataFrames."""
