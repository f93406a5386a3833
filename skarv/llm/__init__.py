"""Operators that prepare text and matches for language models; nothing outside imports this package."""
