"""A PySpark-native engine for memory, retrieval and corpus analytics.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans it.
"""

__version__ = "0.1.0"
