"""Registry of runnable queries: name, family, builder and its DuckDB twin."""

from dataclasses import dataclass
from typing import Callable, Optional


@dataclass(frozen=True)
class Query:
    name: str
    ids: str                      # inventory ids covered
    build: Callable               # (spark, sf_dir) -> DataFrame
    sql: Optional[str] = None
    causal: bool = False          # value at date t uses rows <= t only


QUERIES: dict[str, Query] = {}


def query(name, ids, sql=None, causal=False):
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, ids, fn, sql, causal)
        return fn
    return wrap
