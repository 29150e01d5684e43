"""Column expressions: the entity clock, measures, indicators and Student's t."""
