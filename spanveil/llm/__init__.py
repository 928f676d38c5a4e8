"""Operators for building large training-text collections with Spark."""
