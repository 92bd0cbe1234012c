"""From expression text to Columns, and from an operation log to readable plans."""
