"""Questions to plans, answer handlers, and the query catalogue."""
