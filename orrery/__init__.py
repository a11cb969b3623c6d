"""Orrery: table, image and expression analytics on Spark DataFrames."""
