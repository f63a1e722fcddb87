"""Names, functions and checking SQL of the registered queries."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if statement is not None:
            ORACLE[name] = statement
        return function
    return keep
