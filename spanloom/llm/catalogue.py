"""Every query of the subpackage by name, and the SQL of those SQL can express."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
SQL: dict = {}
for _n in range(1, 10):
    try:
        _m = import_module(f"{__package__}.queries_p{_n}")
    except ModuleNotFoundError as e:
        if not str(e.name).endswith(f"queries_p{_n}"):
            raise
        continue
    QUERIES |= _m.QUERIES
    SQL |= getattr(_m, "SQL", {})
