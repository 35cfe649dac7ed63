"""Compatibility, supply paths, installation space, witnesses and preferences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattices import COMPATIBILITY, ELIGIBILITY, GATE, name, rank, worst_of
from ..sources.storage import cut
from .fronts import tiered_fronts


def checked(required: Column, known: Column, ok: Column) -> Column:
    """One compatibility check: null where it is not required, else ``unknown`` where a fact is missing."""
    return F.when(
        required,
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown")).when(ok, F.lit("compatible")).otherwise(F.lit("incompatible")),
    )


def inferred_checks(asked: Column, given: dict[str, Column]) -> Column:
    """The names of the checks to make: those asked for, if any are; else those whose condition in ``given`` holds."""
    held = F.array_compact(F.array(*[F.when(when, F.lit(name_)) for name_, when in given.items()]))
    return F.when(F.coalesce(F.size(asked) > 0, F.lit(False)), asked).otherwise(held)


def within(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value <= high)


def contains_all(needed: Column, offered: Column) -> Column:
    """Whether every needed token (any case, trimmed) is offered."""
    clean = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    return F.size(F.array_except(clean(needed), clean(offered))) == 0


def requirement_tokens(names: Column) -> Column:
    """Distinct names without case and punctuation; empty ones don't count.  Null is no name."""
    plain = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", ""))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def limit_check(needed: Column, limit: Column, asked: Column | None = None) -> Column:
    """Current or weight: ``needed`` may be as large as ``limit``.  Required where asked for, or where ``needed`` is given."""
    given = needed.isNotNull()
    return checked(given if asked is None else given | asked, given & limit.isNotNull(), needed <= limit)


def supplied_check(needed: Column, installed: Column, asked: Column | None = None) -> Column:
    """Accessories or converters: all that a component needs are installed.  Required where asked for; if nobody says, where
    it needs any and installed ones are listed.  Nothing needed is compatible; an empty list of installed ones is unknown."""
    want, have = requirement_tokens(needed), requirement_tokens(installed)
    any_ = F.size(want) > 0
    required = any_ & (installed.isNotNull() if asked is None else asked)
    return checked(required, F.size(have) > 0, F.size(F.array_except(want, have)) == 0)


def fit_check(space: list[Column], body: list[Column], installed: list[Column], asked: Column | None = None) -> Column:
    """Whether the installed size is at most the space on each axis.  Required where asked for, or where any space is given;
    unknown where the body's own size or any axis of the other two is."""
    given = F.greatest(*[c.isNotNull() for c in space])
    own = F.greatest(*[c.isNotNull() for c in body])
    whole = F.least(*[c.isNotNull() for c in [*space, *installed]])
    inside = F.least(*[i <= s for s, i in zip(space, installed, strict=True)])
    return checked(given if asked is None else given | asked, own & whole, inside)


def compatibility(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with a column per check and ``status``, the worst of the required ones; none required is compatible."""
    out = df.withColumns(checks)
    return out.withColumn("status", worst_of([F.col(c) for c in checks], COMPATIBILITY, "compatible"))


def supply_paths(requirements: DataFrame, paths: DataFrame) -> DataFrame:
    """Requirements (``id, source, target, relationship, continuous_w``) against supply paths (``source, target,
    capability_w``): a required one needs exactly one path of enough capability, a prohibited one none."""
    single = paths.groupBy("source", "target").agg(F.count("*").alias("n_paths"), F.min("capability_w").alias("capability_w"))
    joined = requirements.join(single, ["source", "target"], "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))
    n, need = F.col("n_paths"), F.coalesce("relationship", F.lit("required"))
    code = (
        F.when((need == "prohibited") & (n > 0), F.lit("prohibited_supply_relationship"))
        .when(need != "required", F.lit("ok"))
        .when(n == 0, F.lit("missing_required_supply_path"))
        .when(n > 1, F.lit("multiple_paths_require_explicit_selection"))
        .when(F.col("continuous_w").isNull(), F.lit("ok"))
        .when(F.col("capability_w").isNull(), F.lit("continuous_path_capacity_unresolved"))
        .when(F.col("capability_w") < F.col("continuous_w"), F.lit("continuous_path_capacity_insufficient"))
        .otherwise(F.lit("ok"))
    )
    open_ = ("multiple_paths_require_explicit_selection", "continuous_path_capacity_unresolved")
    return joined.withColumn("code", code).withColumn(
        "severity",
        F.when(F.col("code") == "ok", F.lit("PASS")).when(F.col("code").isin(*open_), F.lit("CONDITIONAL")).otherwise(F.lit("FAIL")),
    )


def installation_envelope(df: DataFrame, size: tuple[Column, Column, Column], axes: Column, clearances: Column) -> DataFrame:
    """``df`` with the space a body needs: its sizes moved to world axes (``axes``: an array, the world axis 0 to 2 of
    each local one) plus the clearances at both faces.  ``clearances`` is an array of categories, each an array of six
    face values (x, y, z faces in pairs of world sides); per face the largest counts, and one missing makes all unknown."""
    body = [
        sum((F.when(F.get(axes, F.lit(k)) == world, size[k]).otherwise(F.lit(0.0)) for k in range(3)), F.lit(0.0))
        for world in range(3)
    ]
    unknown = F.exists(clearances, lambda c: F.exists(c, lambda v: v.isNull()) | (F.size(c) < 6))
    face = lambda k: F.coalesce(F.array_max(F.transform(clearances, lambda c: F.get(c, F.lit(k)))), F.lit(0.0))
    out = {f"need_{axis}": F.when(~unknown, body[i] + face(2 * i) + face(2 * i + 1)) for i, axis in enumerate("xyz")}
    return df.withColumns({**out, "status": F.when(unknown, F.lit("unresolved")).otherwise(F.lit("valid"))})


def source_applicable(there: Column, applicability: Column, legacy: bool = False) -> Column:
    """Whether a source may be used: its applicability was established or reviewed.  One that says nothing about it is usable
    only where older records are asked for (``legacy``); a source that is not there never is."""
    known = applicability.isin("direct_identity", "explicitly_reviewed")
    return F.coalesce(there, F.lit(False)) & F.when(applicability.isNull(), F.lit(legacy)).otherwise(known)


def constraint_gate(kind: Column, evaluators: dict[str, Column]) -> Column:
    """The gate of a constraint, by the evaluator of its kind: a Boolean column, null where it cannot say.  A kind without an
    evaluator is unknown."""
    verdict = F.lit(None).cast("boolean")
    for name_, of in evaluators.items():
        verdict = F.when(kind == name_, of).otherwise(verdict)
    return F.when(verdict, F.lit("YES")).when(~verdict, F.lit("NO")).otherwise(F.lit("UNKNOWN"))


def _bindings(candidates: DataFrame, id_col: str, interfaces: list[str], rules: list[tuple[str, str, str]], ports: DataFrame, ways: DataFrame) -> DataFrame:
    """A row per way to bind the interfaces (``at_<interface>``), with the list ``_of_<path>`` of the ways between the ports of each
    rule.  ``ports`` and ``ways`` are one row per candidate, with the lists ``_ports`` and ``_ways``."""
    out = candidates.select(id_col).join(ports, id_col, "left").join(ways, id_col, "left")
    out = out.select(id_col, "_ports", *[F.col("_ways").alias(f"_of_{n}") for n, _, _ in rules])
    for i in interfaces:
        out = out.select("*", F.explode_outer("_ports").alias("_one")).withColumn(f"at_{i}", F.col("_one.port")).drop("_one")
        for name_, a, b in rules:
            for end, of in (("source", a), ("target", b)):
                if of == i:
                    out = out.withColumn(f"_of_{name_}", F.filter(f"_of_{name_}", lambda w: w[end] == F.col(f"at_{i}")))  # noqa: B023
    return out.drop("_ports")


def product_witnesses(
    candidates: DataFrame, id_col: str, interfaces: list[str], path_rules: list[tuple[str, str, str]], ports: DataFrame, paths: DataFrame, bound: int
) -> DataFrame:
    """Every way to bind the interfaces of a role to the ports of a candidate, and its directed paths to paths between those
    ports: ``id_col``, a column ``at_<interface>`` each and a column ``via_<path>`` each.

    ``ports``: ``id_col, port``; ``paths``: ``id_col, source, target, path``; ``path_rules``: (path, from interface, to interface).
    A candidate without ports, and ports without a path, keep one row with a null in that place.  More than ``bound``
    bindings of one candidate are an error before they are made; nothing is truncated.

    Ports and paths of a candidate meet as lists, once their number is known to be within the bound, and are bound in place, so what is
    shuffled are ports and paths, never bindings.
    """
    counts = ports.groupBy(id_col).count()
    if not counts.where(F.pow("count", F.lit(len(interfaces))) > bound).isEmpty():
        raise ValueError(f"a candidate has more than {bound} bindings of ports")
    rules = sorted(path_rules)
    if not {i for _, *ends in rules for i in ends} <= set(interfaces):
        raise ValueError("a path is between interfaces that the role does not have")
    own = ports.groupBy(id_col).agg(F.collect_list(F.struct("port")).alias("_ports")).join(candidates.select(id_col), id_col, "left_semi")
    between = F.array_contains("_ports.port", F.col("source")) & F.array_contains("_ports.port", F.col("target"))
    listed = lambda df, has, by: df.join(has, id_col).where(between).groupBy(id_col).agg(F.collect_list(F.struct("source", "target", by)).alias("_ways"))
    # where no two paths have the same ends, paths do not multiply bindings
    ways = paths.groupBy(id_col, "source", "target").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if rules and not ways.isEmpty():
        most = ways.groupBy(id_col).agg(F.max("n").alias("_most"))
        doubtful = own.join(most, id_col).where(F.pow(F.size("_ports"), F.lit(len(interfaces))) * F.pow("_most", F.lit(len(rules))) > bound).drop("_most")
        rows = _bindings(doubtful, id_col, interfaces, rules, doubtful, listed(ways, doubtful, "n"))
        each = [F.coalesce(F.get(f"_of_{n}", F.lit(0))["n"], F.lit(1)).cast("double") for n, _, _ in rules]
        if not rows.groupBy(id_col).agg(F.sum(reduce(lambda x, y: x * y, each)).alias("n")).where(F.col("n") > bound).isEmpty():
            raise ValueError(f"a candidate has more than {bound} bindings of paths")
    out = _bindings(candidates, id_col, interfaces, rules, own, listed(paths, own, "path"))
    for name_, _, _ in rules:
        out = out.select("*", F.explode_outer(f"_of_{name_}").alias("_one")).withColumn(f"via_{name_}", F.col("_one.path")).drop("_one", f"_of_{name_}")
    return out.select(id_col, *[f"at_{i}" for i in interfaces], *[f"via_{n}" for n, _, _ in rules])


def enumerate_witnesses(bindings: DataFrame, ports: DataFrame, paths: DataFrame, binding: list[str], port: list[str]) -> DataFrame:
    """Every combination of a binding with one of its ports (``binding`` keys) and one of the port's paths (``port`` keys).

    A binding without a port, and a port without a path, stay as one placeholder row: ``has_port`` and ``has_path`` say
    which part is missing, so that it counts as unknown instead of vanishing.
    """
    with_ports = bindings.join(ports.withColumn("has_port", F.lit(True)), binding, "left")
    with_paths = with_ports.join(paths.withColumn("has_path", F.lit(True)), port, "left")
    return with_paths.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_port", "has_path")})


def witness_status(witnesses: DataFrame, key: list[str], gates: list[str]) -> DataFrame:
    """Per key the best of its witnesses, each as bad as its worst gate: the gates of different witnesses never mix."""
    worst_gate = F.greatest(*[rank(F.col(g), GATE) for g in gates]) if len(gates) > 1 else rank(F.col(gates[0]), GATE)
    each = F.coalesce(worst_gate, F.lit(ELIGIBILITY["ELIGIBLE"]))
    return (
        witnesses.groupBy(*key)
        .agg(F.min(each).alias("_best"), F.count("*").alias("witnesses"))
        .withColumn("status", name(F.col("_best"), ELIGIBILITY, "BLOCKED"))
        .drop("_best")
    )


#: Options of a group that are compared with one another, at most.
MOST_OPTIONS = 1024


def tiered_pairs(
    options: DataFrame, group: list[str], id_col: str, tiers: list[list[tuple[str, bool]]], most: int = MOST_OPTIONS
) -> DataFrame:
    """All pairs a < b of a group, compared tier by tier: ``relation`` of a to b and ``decisive_tier``.

    A group of more than ``most`` options is an error, as its pairs grow with the square; the sizes are counted before.

    A criterion is (column, maximise).  In a tier, an unknown value or wins on both sides are incomparable; the first
    tier that is not tied decides.
    """
    largest = options.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group of {largest} options is beyond the {most} that are compared pair by pair")
    facts = sorted({c for tier in tiers for c, _ in tier})
    left = options.select(*group, F.col(id_col).alias("a"), *[F.col(c).alias(f"_l_{c}") for c in facts])
    right = options.select(*group, F.col(id_col).alias("b"), *[F.col(c).alias(f"_r_{c}") for c in facts])
    pairs = left.join(right, group).where(F.col("a") < F.col("b"))
    relation, decisive = F.lit("tied"), F.lit(None).cast("int")
    for k, tier in reversed(list(enumerate(tiers))):
        ls, rs = [F.col(f"_l_{c}") for c, _ in tier], [F.col(f"_r_{c}") for c, _ in tier]
        any_of: Callable[[list[Column]], Column] = lambda cs: F.coalesce(F.greatest(*cs, F.lit(False)), F.lit(False))
        unknown = any_of([x.isNull() | y.isNull() for x, y in zip(ls, rs, strict=True)])
        wins = any_of([x > y if up else x < y for (_, up), x, y in zip(tier, ls, rs, strict=True)])
        losses = any_of([x < y if up else x > y for (_, up), x, y in zip(tier, ls, rs, strict=True)])
        split = unknown | (wins & losses)
        relation = F.when(split, F.lit("incomparable")).when(wins, F.lit("preferred")).when(losses, F.lit("worse")).otherwise(relation)
        decisive = F.when(split | wins | losses, F.lit(k)).otherwise(decisive)
    return pairs.select(*group, "a", "b", relation.alias("relation"), decisive.alias("decisive_tier"))


def preference_fronts(options: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``id_col, front``: options that none of those left is preferred to, front by front.

    ``pairs`` are those of ``tiered_pairs``, of any number of groups: all groups are peeled at once, each round by two joins
    against the options still left.  A cycle of preferences, which has no front, is an error.
    """
    beats = cut(
        pairs.where(F.col("relation").isin("preferred", "worse"))
        .select(
            F.when(F.col("relation") == "preferred", F.col("a")).otherwise(F.col("b")).alias("winner"),
            F.when(F.col("relation") == "preferred", F.col("b")).otherwise(F.col("a")).alias("loser"),
        )
        .distinct()
    )
    left, fronts = cut(options.select(id_col).distinct()), []
    while not left.isEmpty():
        beaten = cut(beats.select(F.col("loser").alias(id_col)).distinct())
        front = cut(left.join(beaten, id_col, "left_anti"))
        if front.isEmpty():
            raise ValueError("a cycle of preferences has no front")
        fronts.append(front.withColumn("front", F.lit(len(fronts))))
        left = cut(left.join(beaten, id_col, "left_semi"))
        # only wins of options that are left count from here on
        beats = cut(beats.join(front.select(F.col(id_col).alias("winner")), "winner", "left_anti"))
    if not fronts:
        return left.withColumn("front", F.lit(0))
    return reduce(DataFrame.unionByName, fronts)


def recommendation_fronts(
    options: DataFrame, id_col: str, status: str, tiers: list[list[tuple[str, bool]]], excluded: Column | None = None
) -> DataFrame:
    """``id_col, status, front`` of the options that are neither blocked nor ``excluded``; satisfied and unresolved ones
    never meet in a comparison."""
    admitted = options.where(F.col(status).isin("satisfied", "unresolved"))
    if excluded is not None:
        admitted = admitted.where(~F.coalesce(excluded, F.lit(False)))
    return tiered_fronts(admitted, [status], id_col, tiers).select(id_col, status, "front")


def optional_capability(parts: DataFrame, key: list[str], state: str, value: str) -> DataFrame:
    """Three-valued OR over components: present if one is; absent if all applicable are; not applicable if none is."""
    present = F.bool_or(F.coalesce((F.col(state) == "known") & F.col(value), F.lit(False)))
    applicable = F.col(state) != "not_applicable"
    absent = (F.col(state) == "absent") | ((F.col(state) == "known") & ~F.col(value))
    return parts.groupBy(*key).agg(
        F.when(present, F.lit("present"))
        .when(F.count_if(applicable) == 0, F.lit("not_applicable"))
        .when(F.count_if(applicable & F.coalesce(~absent, F.lit(True))) == 0, F.lit("absent"))
        .otherwise(F.lit("unknown"))
        .alias("capability")
    )


def tradeoff_facts(
    parts: DataFrame, key: list[str], numbers: dict[str, str], quantity: str, unit: str, maker: str, counts: dict[str, Column] | None = None
) -> DataFrame:
    """Long facts ``kind, state, value`` per key: totals of value times quantity, unknown where a contributor or the
    unit is; counts of units and of distinct makers; and plain totals of ``counts``, unknown where a contributor is."""
    aggs = []
    for kind, column in numbers.items():
        x = F.col(column) * F.col(quantity)
        ok = (F.count("*") == F.count(x)) & (F.min(unit) == F.max(unit))
        aggs.append(F.when(ok, F.sum(x)).alias(kind))
    aggs.append(F.sum(quantity).cast("double").alias("component_count"))
    aggs.append(F.when(F.count("*") == F.count(maker), F.count_distinct(maker)).cast("double").alias("manufacturer_count"))
    counts = counts or {}
    aggs += [F.when(F.count("*") == F.count(c), F.sum(c)).cast("double").alias(kind) for kind, c in counts.items()]
    wide = parts.groupBy(*key).agg(*aggs)
    kinds = [*numbers, "component_count", "manufacturer_count", *counts]
    return wide.unpivot(key, kinds, "kind", "value").withColumn(
        "state", F.when(F.col("value").isNull(), F.lit("unknown")).otherwise(F.lit("known"))
    )
