"""Selective-review analytics and corpus preparation on Spark."""
