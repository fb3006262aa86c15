"""Analytics over coding-agent session logs, built on Spark DataFrames."""
