"""Eccentricity-profile analytics on Spark DataFrames."""
