"""Operators of a training-data pipeline: similarity joins, classifiers, rules, formats and token work."""
