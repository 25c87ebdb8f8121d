"""Set-wise operators over recorded runs: DataFrames in, DataFrames out."""
