"""Readers, writers and the mapping of the sample star schema."""
