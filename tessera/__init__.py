"""Analytics over code architecture graphs and training corpora, on Spark DataFrames."""
