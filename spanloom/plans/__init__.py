"""Registered plans of the code-graph engine: each module offers QUERIES and ORACLES."""
