"""Whole dataflows built from the operators, and the registered queries."""
