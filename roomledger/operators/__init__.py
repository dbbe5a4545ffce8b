"""The report's building blocks: each takes DataFrames and returns a lazy DataFrame."""
