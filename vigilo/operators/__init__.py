"""Relational operators of the reference re-expressed as DataFrame plans."""
