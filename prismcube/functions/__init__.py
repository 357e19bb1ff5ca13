"""Scalar functions, all built of Spark's own, so that they stay inside generated code."""
