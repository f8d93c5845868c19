"""Eligibility-criteria text analytics as PySpark DataFrame operators."""
