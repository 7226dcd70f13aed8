"""Readers of statement files."""
