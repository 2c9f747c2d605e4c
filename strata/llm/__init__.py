"""Training-data operators: dedup, filters, scoring, mixing and packing.

Nothing else in the package imports from here; the subpackage can be removed
without affecting the document-layout operators.
"""
