"""Inputs and outputs: driver tables, stand-in extracts, CSV, result tables."""
