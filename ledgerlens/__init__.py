"""Statement reconciliation and corpus preparation on Spark DataFrames."""
