"""Spatio-temporal risk analytics on Spark DataFrames."""
