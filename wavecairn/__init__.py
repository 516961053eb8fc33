"""Wavecairn: exact subsequence similarity search over long series, on Spark DataFrames."""
