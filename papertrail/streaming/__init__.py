"""Continuous intake over the batch operators."""
