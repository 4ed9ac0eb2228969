"""lexweave: lexical analytics and corpus preparation on Spark DataFrames."""
