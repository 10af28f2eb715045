"""bizframe: business-record analytics as lazy Spark DataFrames."""
