"""Feeds, tables and scratch storage."""
