"""Domain jobs composed from the operators; each takes and returns DataFrames."""
