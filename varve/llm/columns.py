"""Choosing input columns so that extra columns of any name cannot clash with those an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(columns: list[str], name: str) -> str:
    """A column name that differs from all of ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of the value written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns, cast to the given types; every other column is left behind."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])
