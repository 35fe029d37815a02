"""Recovery and analysis of damaged compressed data with Spark DataFrames."""
