"""Cross-sectional risk and factor analytics on Spark DataFrames."""
