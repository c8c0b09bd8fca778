"""Column kinds, merge rules and value conversions."""
