"""Operators for large text corpora: packing, PII, language ID, quality, WARC, search, LM scoring, BPE, joins.

Nothing else in the library imports this subpackage.
"""
