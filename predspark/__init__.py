"""predspark: typed predicate expressions and corpus operators on Spark DataFrames."""
