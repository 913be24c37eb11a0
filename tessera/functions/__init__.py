"""Scalar semantics of the dialect as Spark columns."""
