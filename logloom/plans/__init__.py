"""Whole pipelines: lines to template groups, and their text and JSON forms."""
