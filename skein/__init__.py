"""Text-to-table extraction and cohort statistics on Spark DataFrames."""
