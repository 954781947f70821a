"""Streams of rows with event times."""
