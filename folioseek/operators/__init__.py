"""Jobs: DataFrames in, DataFrames out."""
