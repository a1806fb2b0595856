"""Operators of a training-data pipeline: dedup, scoring, mixing, packing and search over document tables.

Every operator takes DataFrames and returns DataFrames.  Work on texts runs as Arrow batches over numpy
(`mapInArrow`), relational work stays in DataFrame operations.  Nothing outside this package imports it.
"""
