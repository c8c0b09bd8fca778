"""Quillon: mutable columnar collections as PySpark DataFrames."""
