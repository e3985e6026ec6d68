"""Treebank analytics on PySpark: corpora as DataFrames, queries as joins and windows."""
