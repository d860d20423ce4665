"""Operators of a training-data pipeline: scoring, packing, extraction, filtering, search and joins."""
