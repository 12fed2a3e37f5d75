"""Preparation, profiling and scoring of tables with Spark DataFrames."""
