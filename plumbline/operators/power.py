"""Loads, sources, envelopes and wiring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import electrical as el
from . import aggregates as ag
from . import sequences


def load_demand(loads: DataFrame, key: list[str]) -> DataFrame:
    """Per key the power and energy of its active loads (``supply, power_w, inverter_efficiency, active, duty_cycle,
    runtime_hours``; a load without ``active`` is on).  Battery-side power is known only if every load's is."""
    on = loads.where(F.coalesce("active", F.lit(True)))
    none = F.lit(None).cast("double")
    valid = F.when(el.non_negative(F.col("power_w")), F.col("power_w"))
    side = el.battery_side_power(F.col("supply"), valid, F.col("inverter_efficiency"), none, none, none)
    rows = on.select(*key, valid.alias("p"), side.alias("b"), (side * F.col("runtime_hours") * F.col("duty_cycle")).alias("e"))
    return rows.groupBy(*key).agg(
        F.count("*").alias("loads"),
        ag.known_sum(F.col("p")).alias("load_side_w"),
        ag.complete_sum(F.col("b")).alias("battery_side_w"),
        ag.known_sum(F.col("e")).alias("known_energy_wh"),
        (F.count("*") - F.count("b")).alias("unresolved"),
        F.when(F.count("*") == F.count("b"), F.lit("PASS")).otherwise(F.lit("CONDITIONAL")).alias("severity"),
    )


def usage_profile(uses: DataFrame, key: list[str], power: str, hours: str, period: float) -> DataFrame:
    """Per key: hours covered of ``period``, known energy, and the total where coverage and every power are complete."""
    energy = F.col(power) * F.col(hours)
    covered = F.sum(hours)
    known = F.count("*") == F.count(power)
    return uses.groupBy(*key).agg(
        covered.alias("modeled_hours"),
        ag.known_sum(energy).alias("known_wh"),
        F.when(known & (F.abs(covered - period) <= el.TOLERANCE), F.sum(energy)).alias("total_wh"),
        F.when(covered > period + el.TOLERANCE, F.lit("FAIL"))
        .when(~known | (covered < period - el.TOLERANCE), F.lit("CONDITIONAL"))
        .otherwise(F.lit("PASS"))
        .alias("severity"),
    )


def source_sequence(contributions: DataFrame, interval: str, energy: str) -> DataFrame:
    """Intervals in order, with known and, where no contribution is unknown, total energy."""
    sums = contributions.groupBy(interval).agg(
        ag.known_sum(F.col(energy)).alias("known_wh"), ag.complete_sum(F.col(energy)).alias("total_wh")
    )
    return sequences.numbered(sums, [interval], "sequence_index").withColumn(
        "energy_status", F.when(F.col("total_wh").isNull(), F.lit("unresolved")).otherwise(F.lit("resolved"))
    )


def power_balance(cases: DataFrame, demand: Column, accepted: Column) -> DataFrame:
    """``cases`` with net power, surplus, deficit, state and severity; all unknown where a side is."""
    out = cases.withColumn("net_w", accepted - demand)
    net = F.col("net_w")
    return out.withColumns(
        {
            "surplus_w": F.when(net.isNotNull(), F.greatest(net, F.lit(0.0))),
            "deficit_w": F.when(net.isNotNull(), F.greatest(-net, F.lit(0.0))),
            "balance_state": F.when(net > 0, F.lit("charging")).when(net < 0, F.lit("discharging")).when(net == 0, F.lit("balanced")),
            "severity": F.when(net.isNull(), F.lit("CONDITIONAL")).otherwise(F.lit("PASS")),
        }
    )


def scenario_envelope(scenarios: DataFrame, group: str, id_col: str, power: str, peak: str) -> DataFrame:
    """Per group the largest power and peak with all scenarios that reach them, and whether several bases are mixed."""
    tops = scenarios.groupBy(group).agg(F.max(power).alias("max_power"), F.max(peak).alias("max_peak"), F.count_distinct(id_col).alias("bases"))
    at = scenarios.join(tops, group)
    ids = lambda hit: F.concat_ws(",", F.array_sort(F.collect_set(F.when(hit, F.col(id_col)))))
    return at.groupBy(group).agg(
        F.max("max_power").alias("max_power"),
        ids(F.col(power) == F.col("max_power")).alias("power_governors"),
        F.max("max_peak").alias("max_peak"),
        ids(F.col(peak) == F.col("max_peak")).alias("peak_governors"),
        (F.max("bases") > 1).alias("voltage_conflict"),
    )


def _classified(sources: DataFrame, key: list[str]) -> DataFrame:
    """Sources with ``clash``: active with another of their exclusive group; a source without ``active`` is off."""
    on = F.coalesce("active", F.lit(False))
    crowded = (
        sources.where(on & F.col("exclusive_group").isNotNull())
        .groupBy("exclusive_group")
        .agg(F.count("*").alias("_together"))
    )
    return sources.join(crowded, "exclusive_group", "left").withColumns(
        {
            "on": on,
            "clash": on & (F.coalesce("_together", F.lit(0)) > 1),
            "configured_w": F.coalesce("limit_w", "installed_w"),
        }
    )


def charging_capability(sources: DataFrame, key: list[str]) -> DataFrame:
    """Installed, configured and available power per key, over sources (``installed_w, limit_w, active, availability,
    exclusive_group``); two active members of an exclusive group fail."""
    s = _classified(sources, key)
    counts = F.col("on") & ~F.col("clash")
    usable = lambda when: F.coalesce(F.sum(F.when(when, F.col("configured_w"))), F.lit(0.0))
    return s.groupBy(*key).agg(
        F.sum("installed_w").alias("installed_w"),
        usable(counts & (F.col("availability") != "unavailable")).alias("configured_w"),
        usable(counts & (F.col("availability") == "available")).alias("available_w"),
        F.when(F.bool_or("clash"), F.lit("FAIL"))
        .when(F.bool_or(counts & (F.coalesce("availability", F.lit("unresolved")) == "unresolved")), F.lit("CONDITIONAL"))
        .otherwise(F.lit("PASS"))
        .alias("severity"),
    )


def source_concurrency(sources: DataFrame, key: list[str]) -> DataFrame:
    """Per key, whether its active sources may run together, and the power they then give: the first reason wins."""
    s = _classified(sources, key).where("on")
    clash = F.bool_or("clash")
    away = F.bool_or(F.col("availability") == "unavailable")
    unknown = F.bool_or(F.coalesce("availability", F.lit("unresolved")) == "unresolved")
    power = F.sum(F.least("installed_w", F.coalesce("limit_w", "installed_w")))
    return s.groupBy(*key).agg(
        F.when(clash, F.lit("FAIL")).when(away | unknown, F.lit("CONDITIONAL")).otherwise(F.lit("PASS")).alias("severity"),
        F.when(clash, F.lit("source.concurrent_combination_invalid"))
        .when(away, F.lit("source.not_available_in_scenario"))
        .when(unknown, F.lit("source.available_capability_missing"))
        .otherwise(F.lit("source.pass"))
        .alias("code"),
        F.when(clash | away | unknown, F.lit(0.0)).otherwise(power).alias("available_w"),
    )


def voltage_candidates(df: DataFrame, power: Column, eta: Column, volts: tuple[float, ...]) -> DataFrame:
    """Each row with each candidate voltage and the current it takes."""
    out = df.withColumn("voltage_v", F.explode(F.array(*map(F.lit, volts))))
    return out.withColumn("current_a", el.converted_current(power, F.col("voltage_v"), eta))


def wire_candidates(runs: DataFrame, system_v: Column, most_percent: Column) -> DataFrame:
    """Ampacity and voltage-drop checks of runs (``current_a, ampacity_a, one_way_m, ohm_per_m``); both must pass."""
    length = el.round_trip(F.col("one_way_m"), F.lit(True))
    drop = el.conductor(F.col("current_a"), length, F.col("ohm_per_m"), system_v)["percent_drop"]
    out = runs.withColumn("drop_percent", drop).withColumn("ampacity_passes", F.col("ampacity_a") >= F.col("current_a"))
    out = out.withColumn("drop_passes", F.col("drop_percent") <= most_percent)
    return out.withColumn("eligible", F.col("ampacity_passes") & F.col("drop_passes"))


def derating(df: DataFrame, key: list[str], factor: str) -> DataFrame:
    """Product of the factors of each key, by a combined aggregation; null where a factor is unknown."""
    return df.groupBy(*key).agg(
        F.count("*").alias("factors"), F.when(F.count("*") == F.count(factor), F.product(F.col(factor))).alias("derating")
    )


def shared_capacity(demands: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (``group_id, limit, unit``) against the sum of their demands (``group_id, value, unit``): the limit is
    inclusive, a demand in another unit or none at all leaves a group unresolved."""
    sums = demands.groupBy("group_id").agg(
        F.sum("value").alias("sum"), F.min("unit").alias("u0"), F.max("unit").alias("u1")
    )
    joined = groups.join(sums, "group_id", "left")
    unknown = F.col("sum").isNull() | (F.col("u0") != F.col("unit")) | (F.col("u1") != F.col("unit"))
    return joined.select(
        "group_id",
        F.coalesce("sum", F.lit(0.0)).alias("demand"),
        F.when(unknown, F.lit("UNRESOLVED")).when(F.col("sum") <= F.col("limit"), F.lit("ELIGIBLE")).otherwise(F.lit("BLOCKED")).alias("status"),
    )


def shared_capacity_checks(operations: DataFrame, demands: DataFrame, groups: DataFrame, most: int = 10_000) -> DataFrame:
    """Per operation and subject one ``check`` and its ``status``, with the summed ``demand`` where there is one.

    ``operations``: ``op_id, mode, battery_count, temperature_c, required`` (group ids); ``demands``: ``op_id, path_id,
    value, unit``; ``groups``: ``group_id, mode, battery_count, least_c, most_c, unit, limit, paths, excluded`` (pairs of
    paths ``a, b``), ``open`` (conditions unresolved).  A null condition of a group fits every operation.

    Groups that an operation requires, and all that are declared for its mode, must fit it exactly once.  Demands in
    another unit leave a group unresolved; two paths that exclude each other may not both have a demand; the sum of a
    group may reach its limit.  A demand that no required group of the mode covers is unresolved.

    Groups are a reviewed table of at most ``most`` rows, which is checked, so they are broadcast by mode.  An operation meets its demands on
    the paths of groups, summed by path and unit, as one list and is judged in place; demands that nothing covers are told one by one.
    """
    n = groups.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} groups")
    moded = groups.where(F.col("mode").isNotNull()).groupBy("mode").agg(F.collect_list(F.struct(*groups.columns)).alias("all"))
    by_mode = F.broadcast(moded.agg(F.map_from_entries(F.collect_list(F.struct("mode", "all"))).alias("_by_mode")))
    joined = lambda arrays: F.flatten(F.array_compact(arrays))
    own = operations.where(F.col("op_id").isNotNull()).groupBy("op_id").agg(F.collect_list(F.struct("mode", "battery_count", "temperature_c", "required")).alias("_ops"))
    own = own.select("op_id", "_ops", joined(F.col("_ops.required")).alias("_required")).crossJoin(by_mode)
    own = own.withColumn("_groups", joined(F.transform(F.array_distinct("_ops.mode"), lambda m: F.try_element_at("_by_mode", m)))).drop("_by_mode")
    paths = F.broadcast(groups.select(F.explode("paths").alias("path_id")).distinct())
    sums = demands.join(paths, "path_id", "left_semi").groupBy("op_id", "path_id", "unit")
    sums = sums.agg(F.sum("value").cast("double").alias("sum"), F.bool_or(F.col("value") > 0).alias("positive"))
    lists = sums.groupBy("op_id").agg(F.collect_list(F.struct("path_id", "unit", "sum", "positive")).alias("_demands"))
    wanted = F.explode(F.array_distinct(F.concat("_required", "_groups.group_id")))
    asked = own.join(lists, "op_id", "left").select("op_id", "_ops", "_groups", "_demands", wanted.alias("group_id"))

    def fits(g: Column, o: Column) -> Column:
        warm, cool = o["temperature_c"] >= g["least_c"], o["temperature_c"] <= g["most_c"]
        inside = F.coalesce(warm, g["least_c"].isNull()) & F.coalesce(cool, g["most_c"].isNull())
        bounded = g["least_c"].isNotNull() | g["most_c"].isNotNull()
        counted = g["battery_count"].isNull() | g["battery_count"].eqNullSafe(o["battery_count"])
        return (g["group_id"] == F.col("group_id")) & (g["mode"] == o["mode"]) & counted & (~bounded | (o["temperature_c"].isNotNull() & inside))

    fitting = F.flatten(F.transform("_ops", lambda o: F.filter("_groups", lambda g: fits(g, o))))
    one = asked.select("op_id", "group_id", "_demands", fitting.alias("_fitting"))
    one = one.select("op_id", "group_id", F.size("_fitting").alias("_n"), F.get("_fitting", F.lit(0)).alias("_g"), "_demands")
    one = one.withColumn("_met", F.filter("_demands", lambda d: F.array_contains("_g.paths", d["path_id"]))).drop("_demands")
    unknown = (F.col("_n") != 1) | F.coalesce("_g.open", F.lit(False))
    mixed = F.coalesce(F.exists("_met", lambda d: d["unit"] != F.col("_g.unit")), F.lit(False))
    total = F.coalesce(F.aggregate("_met", F.lit(0.0), lambda x, d: x + F.coalesce(d["sum"], F.lit(0.0))), F.lit(0.0))
    one = one.select("op_id", "group_id", "_g", "_met", unknown.alias("_unknown"), mixed.alias("_mixed"), total.alias("_total"))

    none = F.lit(None).cast("double")
    say = lambda check, subject, status, demand=none: F.struct(
        F.lit(check).alias("check"), subject.cast("string").alias("subject"), status.alias("status"), demand.alias("demand")
    )
    unresolved, group, eligible = F.lit("UNRESOLVED"), F.col("group_id"), F.lit("ELIGIBLE")
    held = say("combined_capacity", group, F.when(F.col("_total") <= F.col("_g.limit"), eligible).otherwise(F.lit("BLOCKED")), F.col("_total"))
    first = F.when(F.col("_unknown"), say("capacity_condition_unknown", group, unresolved)).when(F.col("_mixed"), say("capacity_unit_mismatch", group, unresolved)).otherwise(held)
    active = lambda path: F.coalesce(F.exists("_met", lambda d: (d["path_id"] == path) & d["positive"]), F.lit(False))
    apart = lambda x: say(
        "simultaneous_exclusion", F.concat_ws("/", group, x["a"], x["b"]), F.when(active(x["a"]) & active(x["b"]), F.lit("BLOCKED")).otherwise(eligible)
    )
    pairs = F.when(~F.col("_unknown") & ~F.col("_mixed"), F.transform("_g.excluded", apart))
    judged = one.select("op_id", F.inline(joined(F.array(F.array(first), pairs))))

    covered = joined(F.transform(F.filter("_groups", lambda g: F.array_contains("_required", g["group_id"])), lambda g: g["paths"]))
    cover = own.select(F.col("op_id").alias("_op"), F.array_distinct(covered).alias("_covered")).where(F.size("_covered") > 0)
    bare = demands.join(cover, (F.col("op_id") == F.col("_op")) & F.array_contains("_covered", F.col("path_id")), "left_anti")
    return judged.unionByName(bare.select("op_id", say("demand_capacity_coverage", F.col("path_id"), unresolved).alias("_row")).select("op_id", "_row.*"))


def shared_edges(steps: DataFrame, edge: list[str], route: str) -> DataFrame:
    """Edges that more than one route uses, with their number of routes; capacity is not summed."""
    return steps.select(*edge, route).distinct().groupBy(*edge).agg(F.count("*").alias("routes")).where(F.col("routes") > 1)
