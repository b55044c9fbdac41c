"""corpusloom: Spark-first analytics for web research corpora.

Every operator is a function from DataFrames to a DataFrame; nothing is
collected inside an operator unless its size is bounded and documented.
"""
