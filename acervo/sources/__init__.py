"""Readers of inbox folders and of configuration."""
