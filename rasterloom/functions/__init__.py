"""Functions of strings and scalars, and the registry of primitives."""
