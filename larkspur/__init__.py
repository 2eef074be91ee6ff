"""Larkspur: recommendation experiments with uncertainty, as Spark jobs."""
