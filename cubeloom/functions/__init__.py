"""Scalar functions: text predicates, scorers, parsers and table transforms."""
