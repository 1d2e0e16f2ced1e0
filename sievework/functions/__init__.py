"""Column expressions and the vectorised text kernels behind the Arrow operators."""
