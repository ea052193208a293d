"""Left join of many rows to a keyed table, by its measured size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from glyphloom.session import BROADCAST_BYTES, BROADCAST_ROWS


@dataclass(frozen=True)
class Keyed:
    """A table with a unique ``key``, measured: its size decides how it is joined."""

    table: DataFrame
    key: str
    rows: int
    bytes: int

    @property
    def fits(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES

    def payload(self) -> list[str]:
        return [c for c in self.table.columns if c != self.key]


def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.octet_length(field.name) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.size(field.name) * 8 + 16
    return F.lit(8)


def keyed(table: DataFrame, key: str) -> Keyed:
    """Measure a stored table by one aggregate over it."""
    width = sum((_width(f) for f in table.schema.fields), F.lit(16))
    row = table.agg(F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return Keyed(table, key, row.rows, row.bytes)


def lookup(rows: DataFrame, found: Keyed) -> DataFrame:
    """``rows`` left-joined to the table on its key.

    A table within the broadcast limits is broadcast: no row moves.  Beyond them both sides
    are shuffled; the table has one row per key, so adaptive execution splits heavy keys.
    """
    table = found.table.select(found.key, *found.payload())
    return rows.join(F.broadcast(table) if found.fits else table, found.key, "left")
