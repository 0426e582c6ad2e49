"""Relational operators over submissions and their diagnostics."""
