"""Column expressions behind the rule operators."""
