"""Readers, catalogues, filters of observations, and writers."""
