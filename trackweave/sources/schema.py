"""Canonical columns from tables whose columns go by different names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(table: DataFrame, wanted: Mapping[str, tuple[str, Sequence[str]]], optional: Sequence[str] = ()) -> DataFrame:
    """``table`` with the columns ``wanted`` (name: type and names it may go by), cast to their types.

    Names are compared without case and the first that the table has is taken. A missing optional column is null;
    other missing ones are an error that names them. Rows and their number stay; other columns go.
    """
    have = {c.lower(): c for c in reversed(table.columns)}
    found = {name: next((have[a.lower()] for a in aliases if a.lower() in have), None) for name, (_, aliases) in wanted.items()}
    missing = sorted(n for n, c in found.items() if c is None and n not in optional)
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(sorted(have))}")
    return table.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast(wanted[n][0]).alias(n) for n, c in found.items()])
