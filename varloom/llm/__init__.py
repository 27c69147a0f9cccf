"""Operators of a training-data pipeline over document, page and vector tables."""
