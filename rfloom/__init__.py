"""Receptive-field analytics and data preparation on Spark DataFrames."""
