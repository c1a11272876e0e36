"""Column expressions: calendar parts, buckets and labels."""
