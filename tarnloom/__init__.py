"""A content-registry analytics engine on Spark DataFrames."""
