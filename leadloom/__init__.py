"""Leadloom: reconciliation, ranking and review analytics on Spark DataFrames."""
