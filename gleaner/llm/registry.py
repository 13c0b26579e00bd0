"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("prose", "neighbours", "truncation", "pairs", "history", "repetition", "cutoffs", "encoding", "mixing", "spans")
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    try:
        _module = import_module(f"gleaner.llm.{_name}")
    except ModuleNotFoundError as error:
        if error.name != f"gleaner.llm.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
