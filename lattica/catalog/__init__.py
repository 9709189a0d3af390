"""Schemas as data: catalog tables, fingerprints, diffs, rules, dependency graphs, plans, types and lineage."""
