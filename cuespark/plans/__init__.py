"""Registered queries: each plan wires operators to the tables of a data directory."""
