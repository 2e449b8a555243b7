"""Applying a stream of mutations."""
