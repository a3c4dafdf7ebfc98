"""Strandloom: probabilistic sequence-graph analytics on PySpark DataFrames."""
