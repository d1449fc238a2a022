"""Graph, ownership, linkage and extraction operators: DataFrame to DataFrame."""
