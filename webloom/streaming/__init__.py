"""Structured Streaming forms of the feeds and folds."""
