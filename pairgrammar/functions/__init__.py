"""Column expressions: keys, sequences, geometry and tracks."""
