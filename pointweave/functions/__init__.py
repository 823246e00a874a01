"""Column expressions: pure, built-in, reusable in any plan."""
