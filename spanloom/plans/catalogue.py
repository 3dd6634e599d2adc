"""Every query of the core by name, and the SQL it is compared with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("texts", "spans", "segments", "scores", "samples", "decoding", "reports", "corpus", "stored", "extras")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _c = import_module(f"{__package__}.{_name}").C
    QUERIES |= _c.queries
    SQL |= _c.sql
