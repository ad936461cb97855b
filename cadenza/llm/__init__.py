"""Operators of a training-data pipeline: fingerprints, near-duplicates, tokens, packing, quality, toxicity, WARC.

Nothing outside this folder imports it.
"""
