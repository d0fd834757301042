"""DataFrame operators: keyed writes, lexical and vector search, dedup, models."""
