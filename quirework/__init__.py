"""Quirework: document-structure analytics on Spark."""
