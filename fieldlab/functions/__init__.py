"""Column functions over records, advisory payloads and class probabilities."""
