"""Structured Streaming counterparts of the time-window operators."""
