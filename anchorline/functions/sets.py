"""Membership in constant sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(value: int | str) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(int(value))


def in_list(column: str, values: Iterable[int | str], call: str = "") -> Column:
    """``column IN (values)`` as one parsed expression; any column name will do.

    ``call`` names a function that is applied to the column first.

    Same plan as ``Column.isin``, without one JVM call per value; an empty set
    is never matched.
    """
    items = ", ".join(_literal(value) for value in values)
    quoted = column.replace("`", "``")
    return F.expr(f"{call}(`{quoted}`) IN ({items})") if items else F.lit(False)
