"""Validation of rule-based trading signals on price bars, as Spark DataFrame jobs."""
