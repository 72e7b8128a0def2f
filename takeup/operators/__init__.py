"""Keyed table operators."""
