"""Operators of a training-data pipeline: packing, search, cleaning and mixing of large corpora."""
