"""Operators of a training-data pipeline: dedup, classifiers, mixing, packing, archives, chat."""
