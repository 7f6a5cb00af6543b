"""Registered queries: the operators on the tables, with an equivalent SQL text for each."""
