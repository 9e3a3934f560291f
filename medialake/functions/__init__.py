"""Column expressions. All of them are compositions of built-in functions."""
