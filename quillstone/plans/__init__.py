"""Registries and compilers of formulas, and the queries."""
