"""Operators of a training-data pipeline: texts, vectors and conversations at corpus scale."""
