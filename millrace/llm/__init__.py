"""Operators of a training-data pipeline at corpus scale."""
