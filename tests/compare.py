"""Rows of two engines, as sorted text."""

from __future__ import annotations

import datetime
import decimal
import math


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.10g}"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_from(con, text: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(text)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
