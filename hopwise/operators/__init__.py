"""Graph, aggregation and outlier operators over DataFrames."""
