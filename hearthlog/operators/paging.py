"""Pages behind stable cursors."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hearthlog.functions.scalars import keyset_after


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next_cursor: str | None
    has_more: bool


def clamp(limit: int | None, default: int = 20, most: int = 100) -> int:
    return min(most, max(1, default if limit is None else int(limit)))


def encode_cursor(**parts) -> str:
    return quote(json.dumps(parts, separators=(",", ":"), ensure_ascii=False), safe="")


def decode_cursor(cursor: str | None, *names: str) -> dict | None:
    """The parts, or None for what isn't a cursor; a reader then gets the first page."""
    try:
        parts = json.loads(unquote(cursor or ""))
        return parts if isinstance(parts, dict) and set(names) <= parts.keys() else None
    except ValueError:
        return None


def window_of(df: DataFrame, key: Column, id_col: str, limit: int, descending: bool = True, after: tuple | None = None) -> DataFrame:
    """The first `limit` rows by (key, id) behind `after`, with the key as sort_key. Null keys count as ''."""
    keyed = df.withColumn("sort_key", F.coalesce(key, F.lit("")))
    if after:
        keyed = keyed.filter(keyset_after(F.col("sort_key"), F.col(id_col), *after, descending=descending))
    order = (F.desc, F.asc)[not descending]
    return keyed.orderBy(order("sort_key"), order(id_col)).limit(limit)


def page(df: DataFrame, key: Column, id_col: str = "id", limit: int | None = None, cursor: str | None = None, descending: bool = True, name: str = "key", then: Callable[[DataFrame], DataFrame] | None = None) -> Page:
    """One page; a row more than asked for tells if there are others. `then` adds to the rows of the page."""
    n, parts = clamp(limit), decode_cursor(cursor, name, "id")
    found = window_of(df, key, id_col, n + 1, descending, (parts[name], parts["id"]) if parts else None)
    if then:
        order = (F.desc, F.asc)[not descending]
        found = then(found).orderBy(order("sort_key"), order(id_col))
    rows = found.collect()
    more, items = len(rows) > n, rows[:n]
    return Page(items, encode_cursor(**{name: items[-1]["sort_key"], "id": items[-1][id_col]}) if more else None, more)
