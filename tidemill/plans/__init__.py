"""Whole workflows, and the queries registered with the driver."""
