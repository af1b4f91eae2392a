"""Operators for training-data pipelines; nothing else in terracell imports this subpackage."""
