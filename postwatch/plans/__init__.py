"""Whole jobs built from the operators, and the default vocabularies."""
