"""Audit, evidence and text analytics on Spark DataFrames."""
