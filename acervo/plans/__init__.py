"""Schemas, rules and the shared workspace of a plan."""
