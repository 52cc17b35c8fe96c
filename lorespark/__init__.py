"""Lorespark: knowledge retrieval, ranking, graph and SQL operators on PySpark DataFrames."""
