"""Operators over panels: alignment, labels, features, signals, metrics, models."""
