"""Tidewater: wildlife observation, retrieval and evaluation analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
inside an operator unless its size has been checked first.
"""
