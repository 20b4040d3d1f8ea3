"""Operators over page, link and issue tables."""
