"""A semantic layer over Spark: cubes, reporting requests and post-aggregation analytics as DataFrame plans."""
