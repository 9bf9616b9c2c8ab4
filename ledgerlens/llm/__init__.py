"""Operators of a training-data pipeline: dedup, language, search, mixing, formatting,
tokenising, quality and HTML extraction. Nothing else in the library imports this."""
