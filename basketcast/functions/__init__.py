"""Column functions: calendar, scalars and simple filters."""
