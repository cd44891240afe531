"""Whole runs (move, reconcile, explain) composed from operators, and the query registry."""
