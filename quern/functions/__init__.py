"""Column functions: text keys, parsers, identifiers. All are Catalyst expressions unless they say otherwise."""
