"""Operators that prepare text for language models; nothing outside this package imports it."""
