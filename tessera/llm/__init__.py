"""Training-data operators for large text corpora.

Every operator takes DataFrames and column names, is self-contained in this
subpackage and is imported by nothing outside of it.
"""
