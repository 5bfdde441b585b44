"""Column-level building blocks: text and missing-value tests, numerals, verdicts."""
