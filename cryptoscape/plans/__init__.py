"""Whole inventories built from the operators, and the registered queries."""
