"""Runnable jobs over the given tables: python -m jobs.intake, python -m jobs.site_review."""
