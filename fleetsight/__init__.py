"""Threat intelligence about connected vehicles, as Spark DataFrame jobs."""
