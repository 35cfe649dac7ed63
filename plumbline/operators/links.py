"""Communication claims, references and parent trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .joins import dangling


def claim_pairs(claims: DataFrame, relation: str, term: str, direction: str, exposes: str, participant: str) -> DataFrame:
    """Per relationship and term: the pair of its one exposing and one consuming participant, or why there is none.

    Several exposing claims are ambiguous; a participant does not serve itself.  Sides are counted by one combined
    aggregation, so no claims are paired that do not match.
    """
    out = F.col(direction) == exposes
    sides = claims.groupBy(relation, term).agg(
        F.count_if(out).alias("exposers"),
        F.count_if(~out).alias("consumers"),
        F.min(F.when(out, F.col(participant))).alias("source"),
        F.min(F.when(~out, F.col(participant))).alias("consumer"),
    )
    one = (F.col("exposers") == 1) & (F.col("consumers") == 1)
    code = (
        F.when((F.col("exposers") > 1) & (F.col("consumers") > 0), F.lit("ambiguous_information_source"))
        .when(one & (F.col("source") != F.col("consumer")), F.lit("paired"))
        .otherwise(F.lit("none"))
    )
    paired = F.col("code") == "paired"
    return sides.withColumn("code", code).withColumns(
        {"source": F.when(paired, F.col("source")), "consumer": F.when(paired, F.col("consumer"))}
    )


def requirement_match(requirements: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Requirements with ``status``: satisfied where a fact agrees on all keys, else unknown; absence proves nothing."""
    hit = facts.select(*on).distinct().withColumn("_hit", F.lit(True))
    return requirements.join(hit, on, "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit("satisfied")).otherwise(F.lit("unknown"))
    ).drop("_hit")


def referential_issues(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """``code, reference, rows`` of dangling references: one anti join per (code, child, key, parent, key)."""
    found = None
    for code, child, child_key, parent, parent_key in references:
        rows = (
            dangling(child, parent, child_key, parent_key)
            .groupBy(F.col(child_key).cast("string").alias("reference"))
            .agg(F.count("*").alias("rows"))
            .select(F.lit(code).alias("code"), "reference", "rows")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def cyclic_nodes(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``id_col, cyclic``: whether a node's chain of parents never ends.

    Pointer doubling: after k joins every node points 2**k steps up, or nowhere once its chain has ended.  As long as a
    chain that ends is open, so are all shorter rests of it, and the next doubling ends some of them; so what is open
    when a doubling has ended none runs in a circle.  Rounds grow with the logarithm of the longest chain.
    """
    up = cut(nodes.select(F.col(id_col).alias("n"), F.col(parent_col).alias("up")))
    before, still = None, up.where(F.col("up").isNotNull()).count()
    while still and still != before:
        going = up.where(F.col("up").isNotNull())
        jump = going.select(F.col("n").alias("up"), F.col("up").alias("up2"))
        up = cut(up.join(jump, "up", "left").select("n", F.col("up2").alias("up")))
        before, still = still, up.where(F.col("up").isNotNull()).count()
    return up.select(F.col("n").alias(id_col), F.col("up").isNotNull().alias("cyclic"))


def common_targets(df: DataFrame, key: list[str], member: str, target: str) -> DataFrame:
    """``key, target`` of the targets that every member of the key has: the intersection over members, by counting."""
    pairs = df.select(*key, member, target).distinct()
    members = pairs.select(*key, member).distinct().groupBy(*key).agg(F.count("*").alias("_all"))
    have = pairs.where(F.col(target).isNotNull()).groupBy(*key, target).agg(F.count("*").alias("_n"))
    return have.join(members, key).where(F.col("_n") == F.col("_all")).select(*key, target)


def verified_artifacts(artifacts: DataFrame, references: DataFrame, id_col: str, claimed: str, actual: str) -> DataFrame:
    """``id_col, state`` and ``round`` of artifacts that name others by digest.

    ``references`` are ``id_col, target, digest``.  An artifact is ``altered`` where its ``claimed`` digest is not the ``actual`` one (an unknown one
    is none), ``dangling`` where a target is missing or now has another digest than the reference names, ``unsupported`` where one that it rests
    on, at any distance, is none of the sound ones, and else ``verified``.  ``round`` is the distance of the nearest fault (0: its own; null: none).

    One join per step away from a fault, of the artifacts reached last with the references; so rounds grow with the depth of
    the graph only, and cycles end.  Repeated references count once; ids are unique.
    """
    links = cut(references.select(F.col(id_col).alias("id"), "target", "digest").distinct())
    own = artifacts.select(F.col(id_col).alias("id"), F.coalesce(F.col(claimed) == F.col(actual), F.lit(False)).alias("whole"), F.col(actual).alias("is"))
    targets = own.select(F.col("id").alias("target"), "is")
    fits = F.coalesce(F.col("digest") == F.col("is"), F.lit(False))
    loose = links.join(targets, "target", "left").where(~fits).select("id").distinct().withColumn("loose", F.lit(True))
    first = F.when(~F.col("whole"), F.lit("altered")).when(F.col("loose"), F.lit("dangling"))
    states = cut(own.join(loose, "id", "left").select("id", first.alias("state"), F.when(first.isNotNull(), 0).alias("round")))
    found = reached = cut(states.where("round = 0").select("id"))
    steps, distance = [], 0
    while not reached.isEmpty():
        distance += 1
        above = links.join(reached.withColumnRenamed("id", "target"), "target").select("id").distinct()
        reached = cut(above.join(found, "id", "left_anti"))
        found = cut(found.unionByName(reached))
        steps.append(reached.withColumn("away", F.lit(distance)))
    away = reduce(DataFrame.unionByName, steps) if steps else found.withColumn("away", F.lit(None).cast("int"))
    state = F.coalesce("state", F.when(F.col("away").isNotNull(), F.lit("unsupported")).otherwise(F.lit("verified")))
    return states.join(away, "id", "left").select(F.col("id").alias(id_col), state.alias("state"), F.coalesce("round", "away").alias("round"))
