"""Cohort-scale prioritisation of annotated genomic variants on Spark."""
