"""Operators for preparing large text corpora for language-model training.

Nothing outside this package imports it; it can be deleted without touching the
retrieval engine.
"""
