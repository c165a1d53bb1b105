"""Continuous intake of the feeds."""
