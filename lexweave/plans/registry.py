"""Collects the queries of a module with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.q: dict[str, Callable] = {}
        self.s: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(fn):
            key = name or fn.__name__
            self.q[key] = fn
            if sql is not None:
                self.s[key] = sql
            return fn

        return add

    def queries(self) -> dict[str, Callable]:
        return dict(self.q)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.s)


#: Tokens of documents, in SQL.
TOKS = r"""toks AS (SELECT doc_id, pos, surface, lower(surface) AS token FROM (
  SELECT doc_id, unnest(l) AS surface, unnest(range(1, len(l) + 1)) AS pos FROM (
    SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?') AS l FROM documents WHERE text IS NOT NULL)))"""


def with_toks(sql: str) -> str:
    return f"WITH {TOKS}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {TOKS} {sql}"
