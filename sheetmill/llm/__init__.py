"""Corpus operators for training data: scoring, filtering, de-duplication, search and tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
