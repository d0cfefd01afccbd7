"""Operators of a training-data pipeline: formatting, cleaning, deduplication, classification and mixing."""
