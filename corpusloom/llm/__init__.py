"""Training-data operators: tokens, mixing, quality, dedup, extraction, WARC.

Nothing outside this subpackage imports it.
"""
