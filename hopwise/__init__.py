"""hopwise: batched shortest-path distance queries on weighted graphs, built on PySpark DataFrames."""
