"""quillon: a statistics engine whose operators take and return Spark DataFrames and Columns."""
