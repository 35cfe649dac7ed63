"""Joins that abstain on ambiguity, and enumerations that reject instead of truncating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exactly_one(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """``left`` with ``matches`` (rows of ``right`` with its key), and ``value`` where there is just one.

    ``right`` is reduced to a row per key first, by a combined aggregation, so many matches never multiply rows.
    """
    single = right.groupBy(*on).agg(F.count("*").alias("matches"), F.min(value).alias(value))
    return left.join(single, on, "left").withColumns(
        {"matches": F.coalesce("matches", F.lit(0)).cast("long"), value: F.when(F.col("matches") == 1, F.col(value))}
    )


def coded_left(left: DataFrame, right: DataFrame, on: list[str], found: str, missing: str) -> DataFrame:
    """Left join on unique keys of ``right`` with a ``code`` for hit or miss."""
    marked = right.withColumn("_hit", F.lit(True))
    return left.join(marked, on, "left").withColumn(
        "code", F.when(F.col("_hit"), F.lit(found)).otherwise(F.lit(missing))
    ).drop("_hit")


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose reference has no target; a null reference is dangling too."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(keys, child_key, "left_anti")


def either_key_semi(left: DataFrame, right: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of ``left``, repeated ones included, that agree with ``right`` in any of several composite keys: one join per key
    with its distinct values."""
    out = left
    for i, k in enumerate(keys):
        out = out.join(right.select(*k).distinct().withColumn(f"_hit{i}", F.lit(True)), k, "left")
    any_hit = reduce(lambda a, b: a | b, [F.col(f"_hit{i}").isNotNull() for i in range(len(keys))])
    return out.where(any_hit).select(*left.columns)


def bounded_product(parts: list[DataFrame], bound: int) -> DataFrame:
    """All combinations of one row of each part, or an error where there would be more than ``bound``.

    The counts are taken first; the product itself is thereby known to be small.
    """
    total = 1
    for part in parts:
        total *= part.count()
    if total > bound:
        raise ValueError(f"{total} combinations exceed the bound of {bound}; nothing is truncated")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def unique_rule(df: DataFrame, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """``df`` with ``rule`` and ``rule_status``: the id of the only rule whose pattern the text matches; ``none`` or
    ``ambiguous`` otherwise.  The rule table is part of the projection, so no join is needed."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(i)) for i, p in rules]))
    return df.withColumn("_hits", hits).withColumns(
        {
            "rule": F.when(F.size("_hits") == 1, F.get("_hits", F.lit(0))),
            "rule_status": F.when(F.size("_hits") == 0, F.lit("none"))
            .when(F.size("_hits") == 1, F.lit("matched"))
            .otherwise(F.lit("ambiguous")),
        }
    ).drop("_hits")
