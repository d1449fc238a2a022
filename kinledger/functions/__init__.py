"""Column functions: normalisation, similarity, risk, features."""
