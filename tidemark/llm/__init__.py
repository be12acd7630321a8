"""Training-data operators: one module for each, all on Spark DataFrames.

Nothing else in the library imports this subpackage; its queries and SQL are
in :mod:`tidemark.llm.entry`.
"""
