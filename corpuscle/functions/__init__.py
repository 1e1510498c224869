"""Column expressions and vectorised text helpers."""
