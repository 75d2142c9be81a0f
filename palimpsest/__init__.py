"""palimpsest: a Spark-native engine for agent-memory data.

Every operator is a function from DataFrames to a DataFrame.  Reference times
are parameters, every ranking has a total order, and nothing depends on the
session time zone.
"""

__version__ = "0.1.0"
