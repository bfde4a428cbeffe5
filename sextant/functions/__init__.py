"""Column expressions and the few Arrow helpers the operators are built from."""
