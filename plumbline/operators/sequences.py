"""Ordered sequences: running sums that end at the first gap, and a stored amount kept within bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.electrical import TOLERANCE, finite
from ..sources.storage import cut


def ordered_trajectory(df: DataFrame, key: list[str], order: list[str], power: str, duration: Column, failed: Column) -> DataFrame:
    """``df`` with ``net_energy_wh``, ``energy_status`` and ``cumulative_energy_wh``.

    An interval is failed, unresolved (power or duration unknown) or resolved; the running sum is known only while this
    and every earlier interval of the sequence are resolved.
    """
    ok = finite(F.col(power)) & finite(duration) & (duration >= 0)
    status = F.when(failed, F.lit("failed")).when(ok, F.lit("resolved")).otherwise(F.lit("unresolved"))
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("energy_status", status).withColumn(
        "net_energy_wh", F.when(F.col("energy_status") == "resolved", F.col(power) * duration)
    )
    prefix = F.min((F.col("energy_status") == "resolved").cast("int")).over(so_far) == 1
    return out.withColumn("cumulative_energy_wh", F.when(prefix, F.sum("net_energy_wh").over(so_far)))


def trajectory_summary(intervals: DataFrame, key: list[str]) -> DataFrame:
    """Per sequence: severity, and ending, least and greatest sums (from 0) where it is complete."""
    states = {s: F.count_if(F.col("energy_status") == s) for s in ("failed", "unresolved")}
    whole = (states["failed"] == 0) & (states["unresolved"] == 0)
    low, high = F.least(F.lit(0.0), F.min("cumulative_energy_wh")), F.greatest(F.lit(0.0), F.max("cumulative_energy_wh"))
    return intervals.groupBy(*key).agg(
        F.count("*").alias("intervals"),
        F.when(states["failed"] > 0, F.lit("FAIL")).when(states["unresolved"] > 0, F.lit("CONDITIONAL")).otherwise(F.lit("PASS")).alias("severity"),
        F.when(whole, F.sum("net_energy_wh")).alias("ending_wh"),
        F.when(whole, F.greatest(F.lit(0.0), -low)).alias("max_deficit_wh"),
        F.when(whole, high).alias("max_surplus_wh"),
    )


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stored_energy(
    df: DataFrame, key: list[str], bucket: str, order: list[str], energy: str, start: float, low: float, high: float, failed: Column | None = None
) -> DataFrame:
    """Per key: the amount stored after its last interval, its least and greatest values, and what was curtailed above
    ``high`` and unmet below ``low``.  ``energy`` is the request of each interval.

    From the first interval on that is ``failed`` or whose request is unknown, the state is unknown: then the three state
    columns are null, and the amounts curtailed and unmet are those of the intervals before.  Severity: FAIL where an
    interval failed or a request was not met, CONDITIONAL where one is unknown, else PASS.

    A step is x -> min(high, max(low, x + e)), and steps compose into functions of that same shape.  So each bucket of
    a key (a day, say) is composed by itself; a key's buckets are then chained; and every bucket is walked from the
    state it begins with.  No task sees more of a key than a bucket, or one row per bucket.
    """
    req = F.col(energy)
    step = F.when(F.abs(req) > TOLERANCE, req).otherwise(F.lit(0.0))
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    open_ = ~bad & req.isNull()
    ends = df.groupBy(*key).agg(
        F.min(F.when(bad | open_, F.struct(*order))).alias("_end"), F.count_if(bad).alias("failed"), F.count_if(open_).alias("unresolved")
    )
    before = df.join(ends.select(*key, "_end"), key).where(F.col("_end").isNull() | (F.struct(*order) < F.col("_end")))
    packed = (
        before.groupBy(*key, bucket)
        .agg(F.sort_array(F.collect_list(F.struct(*order, step.alias("e")))).alias("steps"))
    )
    identity = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def compose(f: Column, s: Column) -> Column:
        return F.struct(
            (f["a"] + s["e"]).alias("a"),
            _clamp(f["lo"] + s["e"], low, high).alias("lo"),
            _clamp(f["hi"] + s["e"], low, high).alias("hi"),
        )

    composed = packed.select(*key, F.struct(F.col(bucket).alias("b"), F.aggregate("steps", identity, compose).alias("f")).alias("f"))
    first = F.struct(F.lit(start).alias("x"), F.array().cast("array<double>").alias("begins"))

    def chain(s: Column, c: Column) -> Column:
        f = c["f"]
        after = F.least(F.greatest(s["x"] + f["a"], f["lo"]), f["hi"])
        return F.struct(after.alias("x"), F.concat(s["begins"], F.array(s["x"])).alias("begins"))

    chained = composed.groupBy(*key).agg(F.sort_array(F.collect_list("f")).alias("fs"))
    begins = chained.select(
        *key,
        F.explode(F.arrays_zip(F.col("fs.b").alias("b"), F.aggregate("fs", first, chain)["begins"].alias("x"))).alias("z"),
    ).select(*key, F.col("z.b").alias(bucket), F.col("z.x").alias("begin"))

    seed = F.struct(
        F.col("begin").alias("x"), F.col("begin").alias("least"), F.col("begin").alias("most"),
        F.lit(0.0).alias("curtailed"), F.lit(0.0).alias("unmet"),
    )

    def walk(s: Column, i: Column) -> Column:
        e = i["e"]
        gain = F.least(F.greatest(e, F.lit(0.0)), F.greatest(F.lit(high) - s["x"], F.lit(0.0)))
        given = F.least(F.greatest(-e, F.lit(0.0)), F.greatest(s["x"] - F.lit(low), F.lit(0.0)))
        x = s["x"] + gain - given
        return F.struct(
            x.alias("x"), F.least(s["least"], x).alias("least"), F.greatest(s["most"], x).alias("most"),
            (s["curtailed"] + F.greatest(e, F.lit(0.0)) - gain).alias("curtailed"),
            (s["unmet"] + F.greatest(-e, F.lit(0.0)) - given).alias("unmet"),
        )

    walked = packed.join(begins, [*key, bucket]).select(*key, bucket, F.aggregate("steps", seed, walk).alias("s"))
    sums = walked.groupBy(*key).agg(
        F.max_by("s.x", bucket).alias("_x"), F.min("s.least").alias("_least"), F.max("s.most").alias("_most"),
        F.sum("s.curtailed").alias("_curtailed"), F.sum("s.unmet").alias("_unmet"),
    )
    known = F.col("_end").isNull()
    return ends.join(sums, key, "left").select(
        *key,
        F.when(known, F.col("_x")).alias("stored_wh"),
        F.when(known, F.col("_least")).alias("least_wh"),
        F.when(known, F.col("_most")).alias("most_wh"),
        F.coalesce("_curtailed", F.lit(0.0)).alias("curtailed_wh"),
        F.coalesce("_unmet", F.lit(0.0)).alias("unmet_wh"),
        "failed",
        "unresolved",
        F.when((F.col("failed") > 0) | (F.col("_unmet") > TOLERANCE), F.lit("FAIL"))
        .when(F.col("unresolved") > 0, F.lit("CONDITIONAL"))
        .otherwise(F.lit("PASS"))
        .alias("severity"),
    )


def route_walk(df: DataFrame, key: list[str], order: list[str], source: str, target: str) -> DataFrame:
    """Per route: ``blocked`` unless every edge starts where the one before ended and no node is entered twice."""
    w = Window.partitionBy(*key).orderBy(*order)
    linked = df.withColumn("_gap", F.coalesce(F.lag(target).over(w) != F.col(source), F.lit(False))).withColumn(
        "_back", F.col(target) == F.first(source).over(w)
    )
    return (
        linked.groupBy(*key)
        .agg(
            F.count("*").alias("edges"),
            F.count_if("_gap").alias("gaps"),
            (F.count("*") - F.count_distinct(target) + F.count_if("_back")).alias("revisits"),
        )
        .withColumn(
            "status",
            F.when((F.col("gaps") > 0) | (F.col("revisits") > 0), F.lit("blocked")).otherwise(F.lit("satisfied")),
        )
    )


def carried_forward(df: DataFrame, key: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the last known ``value`` at or before each row of its key.

    ``bucket`` cuts a key into stretches that follow ``order`` (days, say).  A row looks back within its stretch, and
    beyond it to the last value of the nearest earlier stretch that has one, so a key with very many rows is never
    sorted as a whole.
    """
    cut_up = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = cut_up.groupBy(*key, "_bucket").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end")
    )
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*key, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    joined = cut_up.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(before, [*key, "_bucket"], "left")
    return joined.withColumn(out, F.coalesce("_own", "_before")).drop("_bucket", "_own", "_before")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in the whole order, from 0.

    Rows are range-partitioned and sorted; a row's place is its place in the partition after the rows of those before.
    Only one count per partition is summed in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # one row for each partition
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_pos") + F.col("_shift")).drop("_pos", "_part", "_shift")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a combined aggregation instead of a sort of the key's rows."""
    row = F.max(F.struct(*order, F.struct(*[c for c in df.columns if c not in key and c not in order]).alias("_rest")))
    best = df.groupBy(*key).agg(row.alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}") for c in order], "_row._rest.*")


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a tuple of columns; a combined aggregation like ``latest``."""
    row = F.min(F.struct(*order, F.struct(*[c for c in df.columns if c not in key and c not in order]).alias("_rest")))
    best = df.groupBy(*key).agg(row.alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}") for c in order], "_row._rest.*")


def ordinals(df: DataFrame, parent: list[str], tag: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row among those of its tag within its parent, from 1, in document order.  A parent is one
    page or conversation, whose rows of one tag are what a task sorts."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*parent, tag).orderBy(*order)))


def demand_backwards(
    edges: DataFrame, key: list[str], order: list[str], demand: str, usable: str, converts: str, efficiency: str, rating: str, to_limit: str, from_limit: str
) -> DataFrame:
    """Edges of routes with ``to_w, from_w`` and ``status``: what the demand at a route's end asks of both ends of each edge.

    Along the route backwards, an edge that converts asks for its output over its efficiency; others pass on what they
    get.  An edge that is not usable, an efficiency that is unknown or not in (0, 1], and an unknown demand make the power unknown there and in
    all edges before.  An edge is ``blocked`` where a known power is beyond the limit of an end or a converter's rating, else ``unresolved`` where
    the power, or the rating of a converter, is unknown; unknown limits of ends ask for nothing.  The edges of one route are in one task.
    """
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    here, after = back.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    converting = F.coalesce(F.col(converts), F.lit(False))
    sound = F.coalesce((F.col(efficiency) > 0) & (F.col(efficiency) <= 1), F.lit(False)) | ~converting
    out = edges.withColumns({"_factor": F.when(converting & sound, F.col(efficiency)).otherwise(F.lit(1.0)), "_sound": sound})
    known = F.bool_and(F.coalesce(F.col(usable), F.lit(False))).over(here) & F.coalesce(F.bool_and("_sound").over(after), F.lit(True))
    asked = F.col(demand) / F.coalesce(F.product("_factor").over(after), F.lit(1.0))
    out = out.withColumn("to_w", F.when(known, asked)).withColumn("from_w", F.when(F.col("_sound"), F.col("to_w") / F.col("_factor")))
    beyond = lambda w, limit: F.coalesce(F.col(w) > F.col(limit), F.lit(False))
    blocked = beyond("to_w", to_limit) | beyond("from_w", from_limit) | (converting & beyond("to_w", rating))
    open_ = F.col("from_w").isNull() | (converting & F.col(rating).isNull())
    status = F.when(blocked, F.lit("blocked")).when(open_, F.lit("unresolved")).otherwise(F.lit("satisfied"))
    return out.withColumn("status", status).drop("_factor", "_sound")
