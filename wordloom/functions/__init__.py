"""Column functions: normalisation, scores, word classes."""
