"""Bulk plate-material matching and cutting-plan reporting on Spark DataFrames."""
