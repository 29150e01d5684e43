"""Registered queries over the benchmark tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from catalogue import evaluation, features, runs

ENTRIES = {**features.ENTRIES, **evaluation.ENTRIES, **runs.ENTRIES}

QUERIES = {name: entry.build for name, entry in ENTRIES.items()}
ORACLES = {name: entry.sql for name, entry in ENTRIES.items() if entry.sql is not None}
