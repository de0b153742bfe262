"""End-to-end jobs composed from sources, functions and operators."""
