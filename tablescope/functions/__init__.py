"""Reusable column expressions and session helpers."""
