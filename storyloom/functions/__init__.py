"""Column functions: text, rules, vocabularies and similarity."""
