"""Column functions: scores, text rules, vectors, keys, and the SQL function surface."""
