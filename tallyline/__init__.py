"""Entity-history analytics on Spark: DataFrame in, DataFrame out."""
