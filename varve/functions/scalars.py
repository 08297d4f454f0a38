"""Small Column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from varve.vocab import TARGET_PRIORITY


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def safe(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(c), F.lit(default))


def is_target(name: Column) -> Column:
    return F.lower(name).isin(*TARGET_PRIORITY)


def target_rank(name: Column) -> Column:
    """Position in the fixed target priority (exact case), NULL when not a target name."""
    ranks = [F.when(name == t, F.lit(i)) for i, t in enumerate(TARGET_PRIORITY)]
    return F.coalesce(*ranks)


def three_way(value: Column, notable: float, critical: float) -> Column:
    return (
        F.when(value >= critical, "critical").when(value >= notable, "notable").when(value.isNotNull(), "stable")
    )


def status_order(status: Column) -> Column:
    return F.when(status == "absent", -1).when(status == "caution", 1).when(status == "drop", 2).otherwise(0)


def severity_rank(sev: Column) -> Column:
    return F.when(sev == "critical", 2).when(sev == "notable", 1).otherwise(0)


def rank_in(value: Column, ordered: list[str], default: int | None = None) -> Column:
    chain = reduce(
        lambda acc, item: acc.when(value == item[1], item[0]),
        list(enumerate(ordered))[1:],
        F.when(value == ordered[0], 0),
    )
    return chain.otherwise(len(ordered) if default is None else default)


def keep_when(*pairs: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in pairs]))


def slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Least-squares slope from power sums; 0 when all x are equal."""
    denom = n * sxx - sx * sx
    return F.when(denom == 0, F.lit(0.0)).otherwise(F.try_divide(n * sxy - sx * sy, denom))


def num(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def signed(c: Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", c)
