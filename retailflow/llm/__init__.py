"""Operators of training-data pipelines over documents, pages and vectors."""
