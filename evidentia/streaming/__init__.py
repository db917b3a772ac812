"""Stateful limits, in batch and as streams."""
