"""graphloom: graph queries over federated tables, compiled to Spark DataFrames."""

__version__ = "0.1.0"
