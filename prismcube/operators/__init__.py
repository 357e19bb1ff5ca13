"""Filters, rollups, joins, paging and set operations over DataFrames."""
