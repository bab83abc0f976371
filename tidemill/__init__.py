"""Everyday ETL work expressed as Spark SQL plans.

Operators are plain functions from DataFrames to a DataFrame.  Only the load
operators and the CSV sink have side effects.
"""
