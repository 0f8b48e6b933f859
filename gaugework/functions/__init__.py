"""Column expressions: lexical rules, names, ratios, ordering keys."""
