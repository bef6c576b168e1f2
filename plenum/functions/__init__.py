"""Column expressions shared by the operators (no shuffles, no Python workers)."""
