"""Part of the engine; see the package docstring."""
