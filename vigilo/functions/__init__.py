"""Column expressions: cleaning, rounding, naming, labelling."""
