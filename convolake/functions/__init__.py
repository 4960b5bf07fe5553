"""Column functions: text folding, tokens, clocks, vectors and guarded arithmetic."""
