"""Column functions: exact widening, text decoding, calendar values, total order, hashes."""
