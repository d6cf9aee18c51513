"""Whole runs made of the operators, and the registry of named queries."""
