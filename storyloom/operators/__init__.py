"""Relational operators of the engine, DataFrame to DataFrame."""
