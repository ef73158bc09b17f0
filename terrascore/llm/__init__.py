"""Operators for building training corpora: licence scan, near-duplicate
classes, exact top-k search, language and toxicity filters, main-text
extraction, Merkle fingerprints, source mixing, packing and quality grading.
"""
