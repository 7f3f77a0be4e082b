"""kinfold: record linkage, tabular analytics and corpus preparation on Spark DataFrames."""
