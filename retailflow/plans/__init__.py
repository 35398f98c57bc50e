"""Wiring of operators into warehouse loads, analytics and the query registry."""
