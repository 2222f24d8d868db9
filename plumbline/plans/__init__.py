"""Composed jobs (train, explain, analyze), the stand-in tables and the query catalogue."""
