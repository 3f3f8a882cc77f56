"""Operators on pages, candidates, selections and results."""
