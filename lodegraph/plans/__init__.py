"""Whole runs that put operators together and write their tables."""
