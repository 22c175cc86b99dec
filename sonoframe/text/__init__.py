"""Pure functions on text, without Spark; functions/ wraps them for DataFrames."""
