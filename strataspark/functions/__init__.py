"""Column builders: bands, scalar rules, repeatable hashing, test statistics."""
