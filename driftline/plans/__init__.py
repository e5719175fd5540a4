"""Parsers and planners."""
