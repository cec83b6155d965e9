"""graphloom: a PySpark-native engine for graph-structured memory and training-data pipelines.

Every operator is a function from DataFrames to a DataFrame. Catalyst plans
the joins, windows and aggregations; Arrow-batched numpy is used only where
built-in expressions cannot say what is meant.
"""

__version__ = "0.1.0"
