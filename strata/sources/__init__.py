"""Readers of packages and markup, and writers of pages."""
