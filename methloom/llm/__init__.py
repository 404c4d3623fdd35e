"""Operators for training data: tokenizing, chunking, leakage, similarity groups, percentiles."""
