"""Operators over tables of document records, each DataFrame to DataFrame."""
