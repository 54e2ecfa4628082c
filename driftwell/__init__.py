"""driftwell: online learning and table preparation on Spark DataFrames."""
