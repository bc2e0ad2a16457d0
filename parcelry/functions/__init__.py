"""Scalar functions: Column in, Column out; pandas UDFs only for fuzzy similarity."""
