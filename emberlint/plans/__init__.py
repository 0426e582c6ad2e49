"""Whole plans: building training data, serving recommendations, training."""
