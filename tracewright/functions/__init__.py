"""Column functions: formats, names, instruction classes."""
