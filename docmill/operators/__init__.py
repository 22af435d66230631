"""Relational and graph operators as functions from DataFrames to DataFrames."""
