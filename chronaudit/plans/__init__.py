"""Whole audits: several checks over several tables as one plan."""
