"""Bilingual-text processing on Spark: sources, segmentation, translation memory, terms, checks and sinks."""
