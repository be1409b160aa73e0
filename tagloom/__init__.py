"""tagloom: document search, tag graphs and rank learning on Spark DataFrames."""
