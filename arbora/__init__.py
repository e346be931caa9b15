"""Arbora: discrete Bayesian-network analytics on PySpark."""
