"""Training-data operators: secret scans, chat formatting, quality, near-duplicates, language, tokens, repetition, contamination, toxicity, filter audits, whitening.

Nothing outside this package imports it.
"""
