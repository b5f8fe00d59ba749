"""Registered queries, assembled from operators."""
