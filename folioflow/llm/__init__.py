"""Operators for preparing training data: one module each, plus their registered queries."""
