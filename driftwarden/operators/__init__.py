"""Reconciliation operators: DataFrames and parameters in, DataFrame out."""
