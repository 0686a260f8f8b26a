"""Compositions of operators: insights and reports."""
