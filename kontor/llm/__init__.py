"""Operators of a training-data pipeline: dedup, scoring, scanning and mixing."""
