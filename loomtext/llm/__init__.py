"""Operators of a training-data pipeline: tokens, quality, near copies, packing, sharding."""
