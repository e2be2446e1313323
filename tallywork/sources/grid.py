"""Wide period grids: read period columns as long rows, and lay an upload over the standing grid."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F


def period_column(header: str) -> tuple[int, str] | None:
    """(period, 'qty' or 'value') of a header such as `01`, `P1`, `PD01`, `01V`; None for any other column."""
    text = str(header).strip().upper()

    def number(token: str) -> int | None:
        found = re.fullmatch(r"(?:[PD]{1,2}\.?)?0?(\d{1,2})(?:\.0+)?", token)
        return int(found.group(1)) if found and 1 <= int(found.group(1)) <= 13 else None

    for token, kind in (((text[:-1], "value"),) if text.endswith("V") and len(text) > 1 else ()) + ((text, "qty"),):
        period = number(token)
        if period is not None:
            return period, kind
    return None


def melt_grid(grid: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, period, kind, value): the header decides period and kind; blank cells stay null."""
    known = {c: period_column(c) for c in grid.columns if c not in ids}
    cells = [
        F.struct(F.lit(p[0]).alias("period"), F.lit(p[1]).alias("kind"), F.col(f"`{c}`").cast("string").try_cast("double").alias("value"))
        for c, p in known.items() if p
    ]
    return grid.select(*ids, F.inline(F.array(*cells)))


def upsert_grid(standing: DataFrame, upload: DataFrame, key: str) -> DataFrame:
    """Uploaded cells win over the standing grid; products the grid does not know are left out."""
    fresh = upload.join(standing.select(key).distinct(), key, "left_semi").filter("value IS NOT NULL")
    on = [key, "period", "kind"]
    joined = standing.withColumnRenamed("value", "old").join(fresh.withColumnRenamed("value", "new"), on, "full_outer")
    return joined.select(*on, F.coalesce("new", "old").alias("value"))
