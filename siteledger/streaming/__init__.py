"""Submission intake as a stream."""
