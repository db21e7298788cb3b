"""Operators of a training-data pipeline: filters, joins, mixing, tokens, shards."""
