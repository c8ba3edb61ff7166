"""Relational operators over the record model."""
