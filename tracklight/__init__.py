"""Point-in-time actor analytics over bitemporal event tables, as Spark DataFrames."""
