"""Recomputation between versions, in batches and in streams."""
