"""Architecture candidates: choices expanded level by level, and the roles, edges and routes that each candidate needs.

All functions take projects (``project, fixed_voltage``), loads (``project, load, kind, voltage, frequency, power_w, isolated``) and
charging sources (``project, source, source_kind, kind, voltage``); ids are unique in their project, names of projects in all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHOICE = ["project", "house_voltage", "arrangement"]
#: The kind of domain that a charging source must have.
DOMAIN_OF = {"shore": "ac", "solar": "pv_dc", "vehicle": "dc"}


@dataclass(frozen=True)
class Policy:
    voltages: Sequence[float] = (12.0, 24.0, 48.0)
    arrangements: Sequence[str] = ("separate", "combined")
    convert_loads: bool = True
    most_candidates: int = 32
    most_loads: int = 64
    most_sources: int = 16


def expanded(rows: DataFrame, key: str, levels: Sequence[tuple[str, Column, Column | None]], most: int) -> DataFrame:
    """``rows`` with a row per way to choose, level by level: ``(name, array of options, which rows to go on with)``.

    A level's condition may use the choices of levels before it, and prunes before the level is expanded.  The size of the next level is
    counted first; more than ``most`` rows of one key are an error, and nothing is expanded or cut off.  An empty or null array of
    options ends a row.
    """
    for name, options, keep in levels:
        if keep is not None:
            rows = rows.where(F.coalesce(keep, F.lit(False)))
        choices = F.array_distinct(options)
        ways = rows.groupBy(key).agg(F.sum(F.coalesce(F.size(choices), F.lit(0))).alias("n"))
        if not ways.where(F.col("n") > most).isEmpty():
            raise ValueError(f"{name}: more than {most} candidates of one {key}")
        rows = rows.withColumn(name, F.explode(choices))
    return rows


def grouped_loads(loads: DataFrame) -> DataFrame:
    """``loads`` with the ``group`` that supplies them: a complete domain is shared, an incomplete or isolated load is on its own."""
    isolated = F.coalesce("isolated", F.lit(False))
    regular = ((F.col("kind") == "ac") & F.col("frequency").isNotNull()) | ((F.col("kind") == "dc") & F.col("frequency").isNull())
    complete = F.coalesce(F.col("voltage").isNotNull() & regular, F.lit(False))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    domain = F.concat_ws(":", F.coalesce("kind", F.lit("unknown")), number("voltage"), number("frequency"))
    own = F.concat(domain, F.lit("#"), F.col("load").cast("string"))
    return loads.withColumn("isolated", isolated).withColumn("group", F.when(complete & ~isolated, domain).otherwise(own))


def demand_groups(loads: DataFrame) -> DataFrame:
    """Per project and group its domain, number of loads, how many have no known power, and the largest single one."""
    return grouped_loads(loads).groupBy("project", "group").agg(
        F.first("kind").alias("kind"), F.first("voltage").alias("voltage"), F.bool_or("isolated").alias("isolated"), F.count("*").alias("loads"),
        F.count_if(F.col("power_w").isNull()).alias("unknown"), F.max("power_w").alias("least_w"),
    )


def architecture_candidates(projects: DataFrame, loads: DataFrame, sources: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``project, house_voltage, arrangement`` of every candidate, and ``allowed``: whether the policy has that voltage.

    A fixed voltage is kept even where the policy has it not.  Inverter and charger may be combined only for one group of AC loads and
    one shore source.  More loads, sources or candidates of a project than the policy's bounds are an error.
    """
    for rows, what, most in ((loads, "loads", policy.most_loads), (sources, "sources", policy.most_sources)):
        if not rows.groupBy("project").count().where(F.col("count") > most).isEmpty():
            raise ValueError(f"a project has more than {most} {what}")
    ac = demand_groups(loads).groupBy("project").agg(F.count_if(F.col("kind") == "ac").alias("_ac"))
    shore = sources.groupBy("project").agg(F.count_if(F.col("source_kind") == "shore").alias("_shore"))
    known = projects.select("project", "fixed_voltage").join(ac, "project", "left").join(shore, "project", "left")
    offered = F.array(*[F.lit(float(v)) for v in policy.voltages])
    voltages = F.when(F.col("fixed_voltage").isNull(), offered).otherwise(F.array("fixed_voltage"))
    one = F.coalesce((F.col("_ac") == 1) & (F.col("_shore") == 1), F.lit(False))
    arrangements = F.when(one, F.array(*[F.lit(a) for a in policy.arrangements])).otherwise(F.array(F.lit("separate")))
    out = expanded(known, "project", [("house_voltage", voltages, None), ("arrangement", arrangements, None)], policy.most_candidates)
    return out.select(*CHOICE, F.col("house_voltage").isin(*[float(v) for v in policy.voltages]).alias("allowed"))


def _supplied(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates with their groups, and the role between house and group where there is one."""
    differs = F.coalesce(F.col("voltage") != F.col("house_voltage"), F.lit(False))
    needed = (F.col("kind") != "dc") | differs | F.col("isolated")
    combined = (F.col("kind") == "ac") & (F.col("arrangement") == "combined")
    function = F.when(combined, "inverter_charger").when(F.col("kind") == "ac", "inverter").otherwise("dc_conversion")
    both = candidates.select(*CHOICE).join(groups, "project")
    return both.withColumn("function", F.when(F.coalesce(needed, F.lit(True)), function)).withColumn("role", F.concat(F.lit("conversion."), "group"))


def _charged(candidates: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with their sources, and the role that charges from each: a combined one also supplies the AC group."""
    ac = groups.where(F.col("kind") == "ac").groupBy("project").agg(F.min("group").alias("_group"))
    both = candidates.select(*CHOICE).join(sources.select("project", "source", "source_kind", "kind", "voltage"), "project").join(ac, "project", "left")
    shared = (F.col("source_kind") == "shore") & (F.col("arrangement") == "combined")
    role = F.when(shared, F.concat(F.lit("conversion."), "_group")).otherwise(F.concat(F.lit("charging."), F.col("source").cast("string")))
    return both.withColumn("shared", shared).withColumn("role", role)


def candidate_roles(candidates: DataFrame, loads: DataFrame, sources: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row per functional role of every candidate: ``role, function, status, reason, least_w``.

    Next to the roles stand the facts without one: ``house``, the choice of voltage, and loads that are supplied directly (function null).  ``least_w`` is
    what an output must give at least, the largest single load.  A role is ``blocked`` where the policy or the kind of a source forbids it, and
    ``unresolved`` where a voltage or power is unknown, or several loads share an output without a statement which run at once.
    """
    groups = demand_groups(loads)
    none = F.lit(None).cast("double")
    reason = (
        F.when((F.col("function") == "dc_conversion") & F.lit(not policy.convert_loads), F.lit("conversion_not_allowed"))
        .when(F.col("voltage").isNull(), F.lit("domain_voltage_unknown"))
        .when(F.col("unknown") > 0, F.lit("demand_power_unknown"))
        .when(F.col("function").isNotNull() & (F.col("loads") > 1), F.lit("concurrency_not_asserted"))
    )
    supply = _supplied(candidates, groups).select(
        *CHOICE, F.when(F.col("function").isNull(), F.concat(F.lit("direct."), "group")).otherwise(F.col("role")).alias("role"), "function", reason.alias("reason"), F.col("least_w")
    )
    kinds = F.lit(None).cast("string")
    for source, kind in DOMAIN_OF.items():
        kinds = F.when(F.col("source_kind") == source, kind).otherwise(kinds)
    wrong = ~F.coalesce(F.col("kind") == kinds, F.lit(False))
    unclear = (F.col("source_kind") == "vehicle") & F.col("voltage").isNull()
    # a combined role is a row of its own here as well: what its source says of it
    charge = _charged(candidates, groups, sources).select(
        *CHOICE, F.when(F.col("shared"), F.concat(F.lit("charging."), F.col("source").cast("string"))).otherwise(F.col("role")).alias("role"),
        F.when(F.col("shared"), F.lit("inverter_charger")).otherwise(F.lit("charging")).alias("function"),
        F.when(wrong, F.lit("source_kind_conflict")).when(unclear, F.lit("source_voltage_unknown")).alias("reason"), none.alias("least_w"),
    )
    house = candidates.select(
        *CHOICE, F.lit("house").alias("role"), F.lit(None).cast("string").alias("function"),
        F.when(~F.col("allowed"), F.lit("voltage_not_in_policy")).alias("reason"), none.alias("least_w"),
    )
    storage = candidates.select(*CHOICE, F.lit("storage").alias("role"), F.lit("storage").alias("function"), F.lit(None).cast("string").alias("reason"), none.alias("least_w"))
    blocked = F.col("reason").isin("conversion_not_allowed", "source_kind_conflict", "voltage_not_in_policy")
    status = F.when(F.col("reason").isNull(), F.lit("eligible")).when(blocked, F.lit("blocked")).otherwise(F.lit("unresolved"))
    return supply.unionByName(charge).unionByName(house).unionByName(storage).withColumn("status", status).select(*CHOICE, "role", "function", "status", "reason", "least_w")


def candidate_status(roles: DataFrame) -> DataFrame:
    """Per candidate ``status, roles, blocked, unresolved``: blocked if any role is, else unresolved if any is, else eligible."""
    blocked, unclear = F.count_if(F.col("status") == "blocked"), F.count_if(F.col("status") == "unresolved")
    status = F.when(blocked > 0, F.lit("blocked")).when(unclear > 0, F.lit("unresolved")).otherwise(F.lit("eligible"))
    return roles.groupBy(*CHOICE).agg(status.alias("status"), F.count("*").alias("roles"), blocked.alias("blocked"), unclear.alias("unresolved"))


def candidate_edges(candidates: DataFrame, loads: DataFrame, sources: DataFrame) -> DataFrame:
    """``route, step, from_node, to_node, kind`` of every candidate: from the house to each load, from each source to the house, and between
    storage and house.  Kind ``path`` leads through a role, the others are wires."""
    groups = demand_groups(loads)
    edge = lambda a, b, kind="wire": F.struct(a.alias("from_node"), b.alias("to_node"), F.lit(kind).alias("kind"))
    house, port = F.lit("house"), lambda name: F.concat(F.col("role"), F.lit(f".{name}"))
    step = lambda route, steps: [*CHOICE, route.alias("route"), F.posexplode(steps).alias("step", "e")]
    members = grouped_loads(loads).select("project", "group", "load")
    domain, demand = F.concat(F.lit("domain."), "group"), F.concat(F.lit("demand."), F.col("load").cast("string"))
    through = F.array(edge(house, port("dc")), edge(port("dc"), port("output"), "path"), edge(port("output"), domain), edge(domain, demand))
    supply = _supplied(candidates, groups).join(members, ["project", "group"]).select(
        *step(F.concat(F.lit("supply."), F.col("load").cast("string")), F.when(F.col("function").isNull(), F.array(edge(house, domain), edge(domain, demand))).otherwise(through))
    )
    given = F.concat(F.lit("domain.source."), F.col("source").cast("string"))
    inward = F.array(edge(given, port("input")), edge(port("input"), port("dc"), "path"), edge(port("dc"), house))
    charge = _charged(candidates, groups, sources).select(*step(F.concat(F.lit("charge."), F.col("source").cast("string")), inward))
    stored = F.lit("storage.port")
    out = candidates.select(*step(F.lit("storage.discharge"), F.array(edge(stored, house))))
    into = candidates.select(*step(F.lit("storage.charge"), F.array(edge(house, stored))))
    return supply.unionByName(charge).unionByName(out).unionByName(into).select(*CHOICE, "route", "step", "e.*")
