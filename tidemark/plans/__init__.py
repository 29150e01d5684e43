"""Compositions of operators: feature products and model validation."""
