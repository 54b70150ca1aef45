"""Operators for preparing training text: filters, near duplicates, fingerprints, packing.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
