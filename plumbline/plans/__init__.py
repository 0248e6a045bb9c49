"""Registered queries: the operators bound to the test tables."""
