"""Operators of a training-data pipeline: filters, de-duplication, extraction, tokenising and packing."""
