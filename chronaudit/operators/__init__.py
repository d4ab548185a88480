"""Checks and reports as lazy DataFrame transformations."""
