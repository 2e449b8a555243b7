"""Keyed tables and what is done to them."""
