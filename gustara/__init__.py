"""gustara: recommendation and profile analytics on Spark DataFrames."""
