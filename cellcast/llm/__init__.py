"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  Every operator takes DataFrames and returns
DataFrames, reads only the columns it names (so extra columns, also ones that clash with its
outputs, are harmless) and documents what it returns for nulls, empty texts, ties and repeated
rows.  ``queries`` binds the operators to the corpus tables.
"""
