"""Readers and writers of text, JSON, mappings and reports."""
