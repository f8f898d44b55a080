"""Operators over operation logs, runs and levels."""
