"""Registered queries: projections of the tables, the operators over them, and SQL oracles."""
