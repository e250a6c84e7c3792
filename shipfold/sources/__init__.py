"""Sources: files and payloads read into DataFrames of string columns."""
