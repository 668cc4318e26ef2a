"""The analytics operators, each a function from DataFrames to a lazy DataFrame."""
