"""Filters, scores and the binding of the domain tables."""
