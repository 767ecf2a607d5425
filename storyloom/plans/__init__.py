"""The tables that queries read, and the registry of queries."""
