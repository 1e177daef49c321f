"""Set-based activity-pipeline analytics on Spark DataFrames: every tenant in one pass."""
