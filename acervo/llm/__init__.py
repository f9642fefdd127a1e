"""Operators that prepare text for the training of language models; nothing outside this package imports it."""
