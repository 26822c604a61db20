"""Registered queries: one callable per operator over the given tables, with the equivalent SQL."""
