"""Operators for preparing language-model training data, built on Spark DataFrames.

Nothing outside this subpackage imports it; ``queries`` lists its registered queries.
"""
