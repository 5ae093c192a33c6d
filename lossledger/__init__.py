"""Fleet-scale verdicts on machine-learning training runs, declared with Spark DataFrames."""
