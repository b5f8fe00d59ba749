"""Resumable batches as streams."""
