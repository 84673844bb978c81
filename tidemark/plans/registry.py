"""Every registered query of the library (the optional subpackage has its own), with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from ..streaming import runs
from . import audits, decisions, frames, linking, making, proposing, requests, signals, sporting, upkeep
from .dialect import query
from .domain import TABLES

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

for _part in (signals, audits, making):
    for _name, _text in _part.QUERIES.items():
        QUERIES[_name], SQL[_name] = query(_text, TABLES)
for _part in (frames, decisions, requests, upkeep, proposing, sporting, linking, runs):
    for _name, (_run, _text) in _part.QUERIES.items():
        QUERIES[_name] = _run
        if _text:
            SQL[_name] = frames.sql_of(_text)
