"""Operators from DataFrame to DataFrame; reports come back as tidy rows."""
