"""Whole jobs: status grid, layout extraction, reports."""
