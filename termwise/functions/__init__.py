"""Column expressions: term codes, rates, casts and phrase rules."""
