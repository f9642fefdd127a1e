"""Relational operators over the document index."""
