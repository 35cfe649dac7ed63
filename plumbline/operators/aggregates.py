"""Aggregations in which unknown is not zero and ties are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_sum(x: Column) -> Column:
    """Aggregate: the sum, or null where any value is missing."""
    return F.when(F.count("*") == F.count(x), F.coalesce(F.sum(x), F.lit(0.0)))


def known_sum(x: Column) -> Column:
    """Aggregate: the sum of the values that are known."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def guarded_sum(x: Column, valid: Column) -> Column:
    """Aggregate: the sum, or null where any row is invalid."""
    return F.when(F.bool_and(F.coalesce(valid, F.lit(False))), F.sum(x))


def unmixed_sum(x: Column, unit: Column) -> Column:
    """Aggregate: the sum, or null where units mix or a value is missing."""
    return F.when((F.count_distinct(unit) == 1) & (F.count("*") == F.count(x)), F.sum(x))


def one_value(x: Column) -> Column:
    """Aggregate: the group's only distinct value, null where there are several or none."""
    return F.when(F.min(x) == F.max(x), F.min(x))


def governors(df: DataFrame, group: list[str], id_col: str, value: str) -> DataFrame:
    """Per group the maximum of ``value``, how many rows reach it and the least id of them, how many values are unknown and
    the least id of those, and a status.  ``governor_rows`` has the rows themselves.

    One combined aggregation: per group and value first, so that no group is collected or sorted.
    """
    by_value = df.groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(id_col).alias("_first"))
    known, missing = F.col(value).isNotNull(), F.col(value).isNull()
    top = F.max(F.when(known, F.struct(F.col(value).alias("v"), F.col("_n").alias("n"), F.col("_first").alias("first"))))
    out = by_value.groupBy(*group).agg(
        top.alias("_top"), F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).alias("unresolved"), F.min(F.when(missing, F.col("_first"))).alias("first_unresolved")
    )
    return out.select(
        *group,
        F.col("_top.v").alias("max_value"),
        F.coalesce("_top.n", F.lit(0)).cast("long").alias("governors"),
        F.col("_top.first").alias("first_governor"),
        F.col("unresolved").cast("long").alias("unresolved"),
        "first_unresolved",
        F.when(F.col("unresolved") > 0, F.lit("unresolved")).otherwise(F.lit("resolved")).alias("status"),
    )


def governor_rows(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The rows of ``df`` that reach the maximum of their group (``role`` is ``governing``) or whose value is unknown
    (``unresolved``); ties are all kept."""
    top = df.groupBy(*group).agg(F.max(value).alias("_top"))
    role = F.when(F.col(value).isNull(), F.lit("unresolved")).when(F.col(value) == F.col("_top"), F.lit("governing"))
    return df.join(top, group).withColumn("role", role).where(F.col("role").isNotNull()).drop("_top")


def skyline(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Rows that no row of their group beats: none is at least as large in both values and larger in one.

    Equal points survive together.  Only the largest ``b`` of each (group, a) can survive, which a combined aggregation
    finds first; over those points, by falling ``a``, a point survives if its ``b`` exceeds all before it.
    """
    points = df.groupBy(*group, a).agg(F.max(b).alias(b))
    before = Window.partitionBy(*group).orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)
    front = points.withColumn("_best", F.max(b).over(before)).where(F.col("_best").isNull() | (F.col(b) > F.col("_best")))
    return df.join(front.drop("_best"), [*group, a, b], "left_semi")


def grouped_members(df: DataFrame, key: list[Column], member: str, names: list[str]) -> DataFrame:
    """Groups by a composite key, with the number of their rows and of their distinct members, and the first and last of
    these.  ``group_rows`` has the members, a row each."""
    return df.groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)]).agg(
        F.count("*").alias("n"), F.count_distinct(member).alias("n_members"), F.min(member).alias("first_member"), F.max(member).alias("last_member")
    )


def group_rows(df: DataFrame, key: list[Column], member: str, names: list[str]) -> DataFrame:
    """The distinct members of the groups, a row each."""
    return df.select(*[k.alias(n) for k, n in zip(key, names, strict=True)], member).distinct()
