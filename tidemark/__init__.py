"""Cohort feature engine on PySpark: coded event streams in, feature matrices out."""
