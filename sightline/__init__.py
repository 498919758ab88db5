"""Automatic analysis of any table, expressed as Spark jobs."""
