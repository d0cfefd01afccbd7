"""Registered queries: each runs one operator over the given tables, with equivalent SQL to check it."""
