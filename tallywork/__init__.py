"""Accounting-grade reconciliation, costing and clean-up jobs for Spark DataFrames."""
