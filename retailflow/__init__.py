"""Retail event analytics on Spark: event-time windows, star schema, scoring and reports."""
