"""Column functions: identifiers, text rules and vectors."""
