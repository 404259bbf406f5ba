"""Relational operators of the engine: lookups, stateful steps, and the lineage analysis."""
