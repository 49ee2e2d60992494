"""Immutable, totally ordered event logs as Spark DataFrames."""
