"""Histories: decisions replayed against current inputs, facts derived from facts, logs with expected versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut


def _chains(decisions: DataFrame) -> DataFrame:
    """Per proposal: its number of decisions, whether they are a chain, and the last one.

    A decision stands at its own revision with what it refers to, and at the next one with what is to be referred to there, so the two
    meet by aggregation.  Rows that are together by proposal already stay where they are; others are dealt by proposal and revision.
    """
    ahead = F.col("_ahead")
    told = decisions.withColumn("_ahead", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        "proposal", (F.col("revision") + ahead.cast("int")).alias("revision"), "_ahead",
        F.struct(F.when(ahead, F.col("id")).otherwise(F.col("previous")).alias("id"), F.when(ahead, F.col("digest")).otherwise(F.col("previous_digest")).alias("digest")).alias("link"),
        F.when(~ahead, F.struct("id", "proposal_digest", "snapshot", "outcome", "value")).alias("own"),
    )
    steps = told.groupBy("proposal", "revision").agg(
        F.count_if(~ahead).alias("n"), F.min("own").alias("at"), F.min(F.when(~ahead, F.col("link"))).alias("named"), F.min(F.when(ahead, F.col("link"))).alias("prior")
    )
    first = (F.col("revision") == 1) & F.col("named.id").isNull() & F.col("named.digest").isNull()
    follows = (F.col("named.id") == F.col("prior.id")) & (F.col("named.digest") == F.col("prior.digest"))
    good = F.coalesce((F.col("n") == 1) & (first | follows), F.lit(False))
    whole = steps.where(F.col("n") > 0).groupBy("proposal")
    return whole.agg(F.sum("n").alias("decisions"), F.bool_and(good).alias("chained"), F.max_by("at", "revision").alias("last"))


def replayed_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per proposal the state that its decisions leave it in now.

    ``proposals`` are ``proposal, digest, snapshot, value`` as of now; ``decisions`` are ``id, proposal, revision, previous,
    previous_digest, digest, proposal_digest, snapshot, outcome, value``.  Without a decision a proposal is ``automatic``.
    Decisions whose revisions have a gap or a repeat, or whose links are not to the one before, are ``broken``.  If the last
    one was made for another text of the proposal or another snapshot, or there is no such proposal, all are ``stale``.  Else the
    last one's outcome is the state.  ``effective`` is the decided value for ``map``, the proposal's own for ``automatic`` and ``stale``,
    and null otherwise.  ``inert`` counts the decisions that have no effect.  Decisions without a proposal or revision are not seen.

    Links are checked by aggregation per proposal and revision, combined per proposal, so that a proposal with very many decisions is
    no hot key.
    """
    chains = _chains(decisions.where(F.col("proposal").isNotNull() & F.col("revision").isNotNull()))
    both = proposals.select("proposal", F.col("digest"), F.col("snapshot"), F.col("value").alias("automatic"), F.lit(True).alias("here"))
    all_ = both.join(chains, "proposal", "full")
    current = F.coalesce(F.col("here") & (F.col("last.proposal_digest") == F.col("digest")) & (F.col("last.snapshot") == F.col("snapshot")), F.lit(False))
    state = (
        F.when(F.col("decisions").isNull(), F.lit("automatic"))
        .when(~F.col("chained"), F.lit("broken"))
        .when(~current, F.lit("stale"))
        .otherwise(F.col("last.outcome"))
    )
    n = F.coalesce("decisions", F.lit(0).cast("long"))
    own = F.when(F.col("state").isin("automatic", "stale"), F.col("automatic"))
    return all_.withColumn("state", state).select(
        "proposal", "state", F.col("last.id").alias("decision"), n.alias("decisions"),
        (n - F.when(F.col("state").isin("automatic", "broken", "stale"), 0).otherwise(1)).alias("inert"),
        F.when(F.col("state") == "map", F.col("last.value")).otherwise(own).alias("effective"),
    )


def decision_events(replayed: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` with what each is now: ``active``, ``superseded`` by a later one, or ``broken`` or ``stale`` as its proposal is."""
    states = replayed.select("proposal", F.col("state").alias("_state"), F.col("decision").alias("_last"))
    event = F.when(F.col("_state").isin("broken", "stale"), F.col("_state")).when(F.col("id") == F.col("_last"), F.lit("active")).otherwise(F.lit("superseded"))
    return decisions.join(states, "proposal", "left").withColumn("event", F.when(F.col("_state").isNotNull(), event)).drop("_state", "_last")


@dataclass(frozen=True)
class Derivation:
    """A fact that follows from two others of the same product; ``derive`` gives null where it does not."""

    target: str
    inputs: tuple[str, str]
    unit: str
    derive: Callable[[Column, Column], Column]


#: What batteries' facts give.  Voltages that are no whole multiple give no count.
BATTERY = (
    Derivation(
        "usable_capacity_ah", ("nominal_capacity_ah", "usable_fraction"), "Ah",
        lambda capacity, share: F.when((capacity > 0) & share.between(0, 1), capacity * share),
    ),
    Derivation(
        "series_count", ("nominal_voltage_v", "series_voltage_v"), "count",
        lambda one, most: F.when((one > 0) & (most >= one) & (most / one % 1 == 0), most / one),
    ),
)


def derived_facts(facts: DataFrame, rules: Sequence[Derivation], product: str, target: str, value: str, id_col: str) -> DataFrame:
    """``product, target, value, unit, disposition, inputs, direct``: facts that ``rules`` derive, with the ids that each rests on.

    Both inputs must be there exactly once for the product, and known.  Where the product states the target itself, the derived one
    is ``evidence_only`` if that is one fact of the same value, and else ``conflicting``; only a ``mapped`` one is to be used.
    ``direct`` counts the stated ones, of which ``least`` and ``most`` are the extremes.  One aggregation for all rules, combined before the shuffle.
    """
    names = sorted({n for r in rules for n in (r.target, *r.inputs)})
    at = {n: i for i, n in enumerate(names)}
    of = lambda n, c: F.when(F.col(target) == n, F.col(c))
    measures = [
        c
        for n, i in at.items()
        for c in (
            F.count_if(F.col(target) == n).alias(f"_n{i}"), F.min(of(n, value)).alias(f"_lo{i}"), F.max(of(n, value)).alias(f"_hi{i}"), F.min(of(n, id_col)).alias(f"_id{i}"),
        )
    ]

    def row(rule: Derivation) -> Column:
        left, right, own = (at[n] for n in (*rule.inputs, rule.target))
        found = rule.derive(F.col(f"_lo{left}"), F.col(f"_lo{right}"))
        same = (F.col(f"_n{own}") == 1) & F.coalesce(F.col(f"_lo{own}") == found, F.lit(False))
        kind = F.when(F.col(f"_n{own}") == 0, F.lit("mapped")).when(same, F.lit("evidence_only")).otherwise(F.lit("conflicting"))
        out = F.struct(
            F.lit(rule.target).alias("target"), found.alias("value"), F.lit(rule.unit).alias("unit"), kind.alias("disposition"),
            F.array(f"_id{left}", f"_id{right}").alias("inputs"), F.col(f"_n{own}").alias("direct"), F.col(f"_lo{own}").alias("least"), F.col(f"_hi{own}").alias("most"),
        )
        return F.when((F.col(f"_n{left}") == 1) & (F.col(f"_n{right}") == 1) & found.isNotNull(), out)

    wide = facts.where(F.col(target).isin(*names)).groupBy(product).agg(*measures)
    return wide.select(product, F.explode(F.array_compact(F.array(*map(row, rules)))).alias("f")).select(product, "f.*")


def legal(before: Column, after: Column, transitions: Mapping[str, Sequence[str]]) -> Column:
    """Whether a state may follow another; what may come first stands under the empty name."""
    out = F.lit(False)
    for state, following in transitions.items():
        out = out | ((F.coalesce(before, F.lit("")) == state) & after.isin(*following))
    return F.coalesce(out, F.lit(False))


def versioned_log(log: DataFrame, key: str, order: Sequence[str], id_col: str, expected: str, state: str, transitions: Mapping[str, Sequence[str]]) -> DataFrame:
    """``log`` with ``outcome`` and ``version`` of every write, as if they had come one by one in ``order``.

    A write names the write (of its key) that it ``expected`` to be the current one, or null for the first.  It is ``accepted`` if that
    holds and its state may follow, ``illegal`` if only the former holds, and else a ``conflict``.  ``version`` counts accepted writes from 1.
    Ids are unique in a key, ``order`` is total within it, and neither is null; no state has the empty name.  Columns of the log that are
    called ``outcome`` or ``version`` are replaced.

    No key is walked: the write that is accepted after another is the first legal one that expects it, which is an
    aggregate, and a write counts if its chain of those leads back to a first one, which is pointer doubling.  Rounds grow with the
    logarithm of the longest chain.
    """
    writes = log.select(F.col(key).alias("k"), F.col(id_col).alias("id"), F.col(expected).alias("exp"), F.col(state).alias("state"), F.struct(*order).alias("at"))
    named = writes.select("k", F.col("id").alias("exp"), F.col("state").alias("before"), F.col("at").alias("since"))
    linked = writes.join(named, ["k", "exp"], "left")
    there = F.col("exp").isNull() | F.coalesce(F.col("at") > F.col("since"), F.lit(False))
    linked = cut(linked.withColumn("there", there).withColumn("legal", there & legal(F.col("before"), F.col("state"), transitions)))
    heirs = cut(linked.where("legal").groupBy("k", "exp").agg(F.min(F.struct("at", "id")).alias("heir")))
    # how far each heir is from `up`, which is null once the chain has reached its beginning
    steps = cut(heirs.select("k", F.col("heir.id").alias("id"), F.col("exp").alias("up"), F.lit(1).cast("long").alias("far")))
    while not steps.where(F.col("up").isNotNull()).isEmpty():
        above = steps.select("k", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        moved = steps.where(F.col("up").isNotNull()).join(above, ["k", "up"]).select("k", "id", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"))
        steps = cut(steps.where(F.col("up").isNull()).unionByName(moved))
    accepted = steps.select("k", "id", F.col("far").alias("version"))
    parents = accepted.select("k", F.col("id").alias("exp"), F.lit(True).alias("stands"))
    first = F.col("h.exp").eqNullSafe(F.col("w.exp")) & (F.col("h.k") == F.col("w.k"))
    judged = linked.join(accepted, ["k", "id"], "left").join(parents, ["k", "exp"], "left").alias("w").join(heirs.alias("h"), first, "left")
    current = F.col("w.there") & (F.col("w.exp").isNull() | F.col("w.stands")) & (F.col("h.heir").isNull() | (F.col("w.at") <= F.col("h.heir.at")))
    outcome = (
        F.when(F.col("w.version").isNotNull(), F.lit("accepted"))
        .when(F.coalesce(current, F.lit(False)), F.lit("illegal"))
        .otherwise(F.lit("conflict"))
    )
    found = judged.select(F.col("w.k").alias(key), F.col("w.id").alias(id_col), outcome.alias("outcome"), F.col("w.version").alias("version"))
    kept = [c for c in log.columns if c not in ("outcome", "version")]
    return log.select(*kept).join(found, [key, id_col]).select(*kept, "outcome", "version")
