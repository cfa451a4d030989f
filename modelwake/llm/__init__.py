"""Operators for preparing large text corpora for training.

Nothing else in the package imports this folder. Every operator takes DataFrames and
returns DataFrames; the queries over the given tables are in ``queries``.
"""
