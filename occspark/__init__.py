"""Batch jobs for public-safety occurrence data on Spark."""
