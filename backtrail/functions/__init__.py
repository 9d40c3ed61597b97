"""Column expressions: parsing, clocks, amounts, sampling hashes and score arithmetic."""
