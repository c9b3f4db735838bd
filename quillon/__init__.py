"""Quillon: pattern queries, uncertain values and table operators on PySpark DataFrames."""
