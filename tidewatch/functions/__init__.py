"""Column expressions: parsing, scoring and labels. All are Catalyst built-ins, no Python UDF."""
