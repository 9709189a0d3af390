"""Training-data operators: token counts, dedup, packing, quality, fingerprints, LM scores, WARC, PII, near copies, mixing.

Nothing else in the library imports this subpackage.
"""
