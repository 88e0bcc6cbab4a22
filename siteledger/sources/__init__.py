"""Inputs: reader catalogue, import lists, settings, and views over the star-schema tables."""
