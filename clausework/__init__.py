"""Clausework: document-conformance analytics as Spark DataFrame jobs."""
