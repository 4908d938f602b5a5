"""Operators over DataFrames: retrieval, arms, trees, metrics, run control, question sets."""
