"""Preference fronts of options, without pairs of options."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..sources.storage import cut
from . import sequences

#: Distinct vectors of one tier that meet in one task, where a tier has several criteria, at most.
MOST_VECTORS = 1 << 15
#: Distinct values of a tier of one criterion that are summed in one task.
BUCKET = 1 << 16


def longest_before(ranks: list[np.ndarray], heights: np.ndarray) -> np.ndarray:
    """For distinct vectors in ascending order of their ranks (1 is best): the greatest total height of a chain of others that
    each beat the next and all beat the vector.

    Everything that beats a vector stands before it.  Two criteria take a tree of running maxima, more a scan of what stands before.
    """
    before = np.zeros(len(heights), dtype=np.int64)
    if len(ranks) == 2:
        second = ranks[1]
        tree = [0] * (int(second.max(initial=0)) + 1)
        for i, rank in enumerate(second):
            best, at = 0, int(rank)
            while at:
                best, at = max(best, tree[at]), at & (at - 1)
            before[i] = best
            top, at = best + int(heights[i]), int(rank)
            while at < len(tree):
                tree[at], at = max(tree[at], top), at + (at & -at)
        return before
    tops = np.zeros(len(heights), dtype=np.int64)
    for i in range(len(heights)):
        beaten_by = np.logical_and.reduce([r[:i] <= r[i] for r in ranks])
        before[i] = tops[:i].max(initial=0, where=beaten_by)
        tops[i] = before[i] + heights[i]
    return before


@F.pandas_udf(ArrayType(LongType()))
def _longest_before(*columns: pd.Series) -> pd.Series:
    return pd.Series([longest_before(list(row[:-1]), row[-1]) for row in zip(*columns, strict=True)])


def _one_criterion(children: DataFrame, parent: list[str], value: str, up: bool) -> DataFrame:
    """``children`` with ``base``, the heights of all better ones of their parent, summed bucket by bucket in the order of the values."""
    known = children.where(F.col(value).isNotNull())
    better = F.desc(value) if up else F.asc(value)
    placed = sequences.numbered(known, [*[F.asc(c) for c in parent], better], "_place").withColumn("_bucket", F.floor(F.col("_place") / BUCKET))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*parent, "_bucket").orderBy("_place").rowsBetween(*before)
    buckets = placed.groupBy(*parent, "_bucket").agg(F.sum("height").alias("_sum"))
    earlier = buckets.withColumn("_earlier", F.sum("_sum").over(Window.partitionBy(*parent).orderBy("_bucket").rowsBetween(*before)))
    joined = _joined(placed, earlier.drop("_sum"), [*parent, "_bucket"])
    zero = F.lit(0).cast("long")
    base = F.coalesce("_earlier", zero) + F.coalesce(F.sum("height").over(inside), zero)
    return joined.withColumn("base", base).select(*children.columns, "base").unionByName(_unknown(children, value))


def _many_criteria(children: DataFrame, parent: list[str], tier: list[tuple[str, bool]], most: int) -> DataFrame:
    """``children`` with ``base``, the greatest height of a chain above them; the vectors of one parent, at most ``most``, meet in one task."""
    known = children.where(F.col(tier[0][0]).isNotNull())
    largest = known.groupBy(*parent).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} distinct vectors of {[c for c, _ in tier]} are beyond the {most} that are compared in one task")
    ranks = {
        f"_r{j}": F.dense_rank().over(Window.partitionBy(*parent).orderBy(F.desc(c) if up else F.asc(c))) for j, (c, up) in enumerate(tier)
    }
    values = [c for c, _ in tier]
    packed = known.withColumns(ranks).groupBy(*parent).agg(F.sort_array(F.collect_list(F.struct(*ranks, "height", *values))).alias("_xs"))
    bases = packed.withColumn("_bases", _longest_before(*[F.col(f"_xs.{r}") for r in ranks], F.col("_xs.height")))
    each = bases.select(*parent, F.explode(F.arrays_zip("_xs", "_bases")).alias("_z"))
    found = each.select(*parent, *[F.col(f"_z._xs.{c}").alias(c) for c in [*values, "height"]], F.col("_z._bases").alias("base"))
    return found.select(*children.columns, "base").unionByName(_unknown(children, values[0]))


def _unknown(children: DataFrame, value: str) -> DataFrame:
    return children.where(F.col(value).isNull()).withColumn("base", F.lit(0).cast("long"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which nulls are equal."""
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on: Column = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_k_{k}"])
    return left.join(other, on, "left").drop(*[f"_k_{k}" for k in keys])


def tiered_fronts(
    options: DataFrame, group: list[str], id_col: str, tiers: list[list[tuple[str, bool]]], most: int = MOST_VECTORS
) -> DataFrame:
    """``options`` with ``front``: 0 where no option of the group is preferred, else one more than the last front that has a preferred one.

    Options are compared as ``selection.tiered_pairs`` does: a criterion is (column, maximise); the first tier that is not tied decides; in
    a tier an unknown value or wins on both sides are incomparable.  That is a strict order, so an option's front is the length of the
    longest chain above it.  Equal options share a front; an option with an unknown value in a tier is beaten by what earlier tiers
    decide only; one without a group is compared with none.  No tiers, or no options, are fine; a column ``front`` is replaced.

    No pair is made.  From the last tier to the first, the options that agree in all tiers before are a parent, and their distinct vectors
    are its children, whose height is the number of fronts inside.  A tier of one criterion is a running sum of heights, bucket by
    bucket.  One of several criteria is a longest chain over the distinct vectors of a parent in one task; more than ``most`` of these are an
    error, found by counting before.
    """
    options = options.drop("front")
    names = {c: f"_t{k}_{j}" for k, tier in enumerate(tiers) for j, (c, _) in enumerate(tier)}
    if len(names) != sum(len(tier) for tier in tiers):
        raise ValueError("a criterion stands in one tier only")
    own = [f"_g{i}" for i in range(len(group))]
    known, masked = F.lit(True), {o: F.col(g) for o, g in zip(own, group, strict=True)}
    for g in group:
        known = known & F.col(g).isNotNull()
    for tier in tiers:
        for c, _ in tier:
            known = known & F.col(c).isNotNull()
        masked |= {names[c]: F.when(known, F.col(c)) for c, _ in tier}
    coded = options.withColumns(masked)
    values = [list(own)] + [[names[c] for c, _ in tier] for tier in tiers]
    vectors = cut(coded.select(*masked).distinct().withColumn("front", F.lit(0).cast("long"))) if tiers else None
    for k in reversed(range(len(tiers))):
        parent = [c for level in values[: k + 1] for c in level]
        tier = [(names[c], up) for c, up in tiers[k]]
        if not tier:
            continue
        key = [*parent, *values[k + 1]]
        children = vectors.groupBy(*key).agg((F.max("front") + 1).alias("height"))
        based = _one_criterion(children, parent, *tier[0]) if len(tier) == 1 else _many_criteria(children, parent, tier, most)
        vectors = cut(_joined(vectors, based.drop("height"), key).withColumn("front", F.col("front") + F.col("base")).drop("base"))
    if vectors is None:
        return options.withColumn("front", F.lit(0))
    out = _joined(coded, vectors, list(masked))
    return out.select(*options.columns, F.col("front").cast("int").alias("front"))
