"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; ``queries.py`` registers one query
per operator and ``corpus_pipeline.py`` chains five of them.
"""
