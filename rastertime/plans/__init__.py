"""End-to-end recipes and the query catalogue."""
