"""Tabular classification on Spark: delimited text in, tuned forest and metrics out."""
