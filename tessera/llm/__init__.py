"""Operators of a training-data pipeline (license scans, token counts, packing,
LM scoring, quality rules, substring dedup, language ID, near-duplicate join,
piece encoding, fingerprints) and the queries that apply them.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
