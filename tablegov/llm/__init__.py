"""Operators for preparing training data for language models, one module each.

Nothing else in the library imports this package; ``queries`` registers one
query per operator and ``corpus_pipeline.py`` chains four of them.
"""
