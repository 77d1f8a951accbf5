"""Operators that prepare text for language-model training.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside this
subpackage imports it; ``queries.py`` holds the queries that the repository
registers.
"""
