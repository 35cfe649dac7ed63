"""Compatibility, preference, advisories, catalogues and references, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advisories as adv
from ..operators import aggregates as ag
from ..operators import fronts, joins, links
from ..operators import selection as sel
from ._registry import Tables, bind


@bind(
    """WITH c AS (SELECT p_partkey,
  CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN 24 BETWEEN p_size AND p_size + 10 THEN 'compatible' ELSE 'incompatible' END AS voltage,
  CASE WHEN p_retailprice >= 1000 THEN 'compatible' ELSE 'incompatible' END AS power,
  CASE WHEN p_type LIKE '%PROMO%' THEN NULL WHEN p_name LIKE '%a%' THEN 'compatible' ELSE 'unknown' END AS interface FROM part)
SELECT p_partkey, voltage, power, interface, CASE WHEN voltage = 'incompatible' OR power = 'incompatible' THEN 'incompatible'
  WHEN voltage = 'unknown' OR interface = 'unknown' THEN 'unknown' ELSE 'compatible' END AS status FROM c"""
)
def component_compat(t: Tables) -> DataFrame:
    low = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    checks = {
        "voltage": sel.checked(F.lit(True), low.isNotNull(), sel.within(F.lit(24), low, low + 10)),
        "power": sel.checked(F.lit(True), F.lit(True), F.col("p_retailprice") >= 1000),
        "interface": sel.checked(~F.col("p_type").like("%PROMO%"), F.col("p_name").like("%a%"), F.lit(True)),
    }
    return sel.compatibility(t.part, checks).select("p_partkey", *checks, "status")


@bind(
    """WITH p AS (SELECT s_nationkey AS source, s_suppkey % 25 AS target, abs(s_acctbal) AS cap FROM supplier),
g AS (SELECT source, target, count(*) AS n, min(cap) AS cap FROM p GROUP BY 1, 2),
r AS (SELECT c_custkey, c_nationkey AS source, c_custkey % 25 AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 'prohibited' END AS rel,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS need FROM customer),
j AS (SELECT r.*, coalesce(n, 0) AS n, cap FROM r LEFT JOIN g USING (source, target)),
k AS (SELECT c_custkey, n AS n_paths, CASE WHEN rel = 'prohibited' AND n > 0 THEN 'prohibited_supply_relationship' WHEN rel = 'prohibited' THEN 'ok'
  WHEN n = 0 THEN 'missing_required_supply_path' WHEN n > 1 THEN 'multiple_paths_require_explicit_selection' WHEN need IS NULL THEN 'ok'
  WHEN cap < need THEN 'continuous_path_capacity_insufficient' ELSE 'ok' END AS code FROM j)
SELECT *, CASE WHEN code = 'ok' THEN 'PASS' WHEN code = 'multiple_paths_require_explicit_selection' THEN 'CONDITIONAL' ELSE 'FAIL' END AS severity FROM k"""
)
def mixed_voltage_paths(t: Tables) -> DataFrame:
    paths = t.supplier.select(
        F.col("s_nationkey").cast("long").alias("source"), (F.col("s_suppkey") % 25).alias("target"), F.abs("s_acctbal").alias("capability_w")
    )
    needs = t.customer.select(
        "c_custkey", F.col("c_nationkey").cast("long").alias("source"), (F.col("c_custkey") % 25).alias("target"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("prohibited")).alias("relationship"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("continuous_w"),
    )
    return sel.supply_paths(needs, paths).select("c_custkey", "n_paths", "code", "severity")


@bind(
    """WITH s AS (SELECT p_partkey, p_size::DOUBLE AS a, p_size * 2.0::DOUBLE AS b, p_size * 3.0::DOUBLE AS c, p_partkey % 3 AS turn, p_size % 10 = 0 AS gap FROM part),
w AS (SELECT *, CASE turn WHEN 0 THEN a WHEN 1 THEN c ELSE b END AS x, CASE turn WHEN 0 THEN b WHEN 1 THEN a ELSE c END AS y,
  CASE turn WHEN 0 THEN c WHEN 1 THEN b ELSE a END AS z FROM s)
SELECT p_partkey, CASE WHEN NOT gap THEN x + 15 END AS need_x, CASE WHEN NOT gap THEN y + 40 END AS need_y, CASE WHEN NOT gap THEN z + 70 END AS need_z,
  CASE WHEN gap THEN 'unresolved' ELSE 'valid' END AS status FROM w"""
)
def installation_envelope(t: Tables) -> DataFrame:
    s = F.col("p_size").cast("double")
    turn = F.col("p_partkey") % 3
    axes = F.when(turn == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(turn == 1, F.array(F.lit(1), F.lit(2), F.lit(0)))
    axes = axes.otherwise(F.array(F.lit(2), F.lit(0), F.lit(1)))
    service = F.array(*[F.lit(float(v)) for v in (5, 10, 15, 20, 30, 40)])
    cable = F.array(*[F.when(F.col("p_size") % 10 != 0, F.lit(float(v))) for v in (2, 3, 20, 4, 5, 6)])
    out = sel.installation_envelope(t.part, (s, s * 2, s * 3), axes, F.array(service, cable))
    return out.select("p_partkey", "need_x", "need_y", "need_z", "status")


@bind("SELECT p_type, p_size, count(*) AS n, min(p_partkey) AS first_member, max(p_partkey) AS last_member FROM part GROUP BY 1, 2")
def demand_groups(t: Tables) -> DataFrame:
    out = ag.grouped_members(t.part, [F.col("p_type"), F.col("p_size")], "p_partkey", ["p_type", "p_size"])
    return out.select("p_type", "p_size", "n", "first_member", "last_member")


@bind("SELECT r_name, n_name, v::DOUBLE AS voltage_v FROM region, nation, (VALUES (12), (24), (48)) c(v)")
def bounded_cross(t: Tables) -> DataFrame:
    """The bound of 1,000 combinations is part of the operator: more would be an error."""
    volts = t.spark.createDataFrame([(12.0,), (24.0,), (48.0,)], "voltage_v double")
    return joins.bounded_product([t.region.select("r_name"), t.nation.select("n_name"), volts], 1000)


@bind(
    """WITH w AS (SELECT l_partkey, greatest(CASE WHEN l_discount > 0.07 THEN 3 WHEN l_discount > 0.04 THEN 2 ELSE 1 END,
  CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS r FROM lineitem)
SELECT l_partkey, count(*) AS witnesses, CASE min(r) WHEN 1 THEN 'ELIGIBLE' WHEN 2 THEN 'UNRESOLVED' ELSE 'BLOCKED' END AS status FROM w GROUP BY 1"""
)
def witness_existential(t: Tables) -> DataFrame:
    d, flag = F.col("l_discount"), F.col("l_returnflag")
    gates = t.lineitem.select(
        "l_partkey",
        F.when(d > 0.07, F.lit("NO")).when(d > 0.04, F.lit("UNKNOWN")).otherwise(F.lit("YES")).alias("g1"),
        F.when(flag == "R", F.lit("NO")).when(flag == "A", F.lit("UNKNOWN")).otherwise(F.lit("YES")).alias("g2"),
    )
    return sel.witness_status(gates, ["l_partkey"], ["g1", "g2"])


def nation_options(t: Tables) -> DataFrame:
    """Nations of a region as options: balance, suppliers and customers, one of them unknown here and there."""
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.floor(F.sum("s_acctbal") / 10000).alias("balance"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    out = t.nation.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return out.withColumn("customers", F.when(F.col("n_nationkey") % 9 != 0, F.col("customers")))


_OPTIONS_SQL = """
s AS (SELECT s_nationkey, count(*) AS suppliers, floor(sum(s_acctbal) / 10000) AS balance FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1),
o AS (SELECT n_nationkey, n_regionkey, suppliers, balance, CASE WHEN n_nationkey % 9 <> 0 THEN customers END AS customers
  FROM nation LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN c ON c_nationkey = n_nationkey)
"""


def _pairs_sql(group: str) -> str:
    """CTEs after options ``o``: ``p`` with the relation of all pairs of a group, and ``w`` with the lengths of chains of
    options that are each preferred to the next (the longest is an option's front)."""
    return f"""
x AS (SELECT l.{group}, l.n_nationkey AS a, r.n_nationkey AS b,
    l.suppliers IS NULL OR r.suppliers IS NULL OR l.balance IS NULL OR r.balance IS NULL AS u0,
    coalesce(l.suppliers > r.suppliers, false) OR coalesce(l.balance > r.balance, false) AS w0,
    coalesce(l.suppliers < r.suppliers, false) OR coalesce(l.balance < r.balance, false) AS x0,
    l.customers IS NULL OR r.customers IS NULL AS u1, coalesce(l.customers < r.customers, false) AS w1, coalesce(l.customers > r.customers, false) AS x1
  FROM o l JOIN o r ON l.{group} = r.{group} AND l.n_nationkey < r.n_nationkey),
p AS (SELECT {group}, a, b, CASE WHEN u0 OR (w0 AND x0) THEN 'incomparable' WHEN w0 THEN 'preferred' WHEN x0 THEN 'worse'
    WHEN u1 OR (w1 AND x1) THEN 'incomparable' WHEN w1 THEN 'preferred' WHEN x1 THEN 'worse' ELSE 'tied' END AS relation,
  CASE WHEN u0 OR w0 OR x0 THEN 0 WHEN u1 OR w1 OR x1 THEN 1 ELSE -1 END AS decisive_tier FROM x),
d AS (SELECT CASE WHEN relation = 'preferred' THEN a ELSE b END AS winner, CASE WHEN relation = 'preferred' THEN b ELSE a END AS loser
  FROM p WHERE relation IN ('preferred', 'worse')),
w AS (SELECT n_nationkey, 0 AS front FROM o UNION SELECT loser, front + 1 FROM w JOIN d ON winner = w.n_nationkey)
"""


_TIERS = [[("suppliers", True), ("balance", True)], [("customers", False)]]


@bind(f"WITH RECURSIVE {_OPTIONS_SQL}, {_pairs_sql('n_regionkey')} SELECT n_regionkey, a, b, relation, decisive_tier FROM p")
def tiered_pareto_pairs(t: Tables) -> DataFrame:
    pairs = sel.tiered_pairs(nation_options(t), ["n_regionkey"], "n_nationkey", _TIERS)
    return pairs.withColumn("decisive_tier", F.coalesce("decisive_tier", F.lit(-1)))


@bind(
    f"""WITH RECURSIVE {_OPTIONS_SQL}, {_pairs_sql('n_regionkey')}
SELECT n_nationkey, max(front)::INTEGER AS front FROM w GROUP BY 1"""
)
def pareto_fronts(t: Tables) -> DataFrame:
    return fronts.tiered_fronts(nation_options(t), ["n_regionkey"], "n_nationkey", _TIERS).select("n_nationkey", "front")


@bind(
    """WITH RECURSIVE o AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS size, p_retailprice AS price,
  CASE WHEN p_partkey % 13 <> 0 THEN length(p_name) END AS long FROM part),
d AS (SELECT a.p_partkey AS winner, b.p_partkey AS loser FROM o a JOIN o b ON a.p_brand = b.p_brand
  WHERE a.size > b.size OR (a.size = b.size AND ((a.long < b.long AND a.price <= b.price) OR (a.long <= b.long AND a.price < b.price)))),
w AS (SELECT p_partkey, 0 AS front FROM o UNION SELECT loser, front + 1 FROM w JOIN d ON winner = p_partkey)
SELECT p_partkey, p_brand, max(front)::INTEGER AS front FROM w JOIN o USING (p_partkey) GROUP BY 1, 2"""
)
def part_fronts(t: Tables) -> DataFrame:
    """Parts as options of their brand: large ones first, then short names at a low price; some sizes and names are unknown."""
    k = F.col("p_partkey")
    options = t.part.select(
        "p_partkey", "p_brand", F.when(k % 11 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"),
        F.when(k % 13 != 0, F.length("p_name")).alias("long"),
    )
    tiers = [[("size", True)], [("long", False), ("price", False)]]
    return fronts.tiered_fronts(options, ["p_brand"], "p_partkey", tiers).select("p_partkey", "p_brand", "front")


@bind(
    f"""WITH RECURSIVE {_OPTIONS_SQL.replace('o AS', 'every AS')},
o AS (SELECT *, CASE WHEN n_nationkey % 3 = 1 THEN 'unresolved' ELSE 'satisfied' END AS status FROM every WHERE n_nationkey % 7 <> 3), {_pairs_sql('status')}
SELECT n_nationkey, status, max(front)::INTEGER AS front FROM w JOIN o USING (n_nationkey) GROUP BY 1, 2"""
)
def recommendation_fronts(t: Tables) -> DataFrame:
    """Nations as system options over all regions; satisfied and unresolved ones have fronts of their own, blocked ones none."""
    k = F.col("n_nationkey")
    status = F.when(k % 7 == 3, F.lit("blocked")).when(k % 3 == 1, F.lit("unresolved")).otherwise(F.lit("satisfied"))
    options = nation_options(t).withColumn("status", status)
    return sel.recommendation_fronts(options, "n_nationkey", "status", _TIERS)


@bind(
    """WITH p AS (SELECT l_orderkey, CASE WHEN l_tax < 0.078 THEN l_extendedprice END AS cost, l_discount * 100 AS weight, l_quantity AS q, l_linestatus AS unit,
  CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS maker, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity ELSE 0 END AS reused, CASE WHEN l_discount < 0.09 THEN l_linenumber END AS paths FROM lineitem),
w AS (SELECT l_orderkey, CASE WHEN count(*) = count(cost) AND min(unit) = max(unit) THEN sum(cost * q) END AS purchase_cost,
  CASE WHEN min(unit) = max(unit) THEN sum(weight * q) END AS weight, sum(q) AS component_count,
  CASE WHEN count(*) = count(maker) THEN count(DISTINCT maker) END::DOUBLE AS manufacturer_count, sum(reused) AS reuse_existing, CASE WHEN count(*) = count(paths) THEN sum(paths) END::DOUBLE AS selected_power_path_count FROM p GROUP BY 1),
u AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR kind IN (purchase_cost, weight, component_count, manufacturer_count, reuse_existing, selected_power_path_count)))
SELECT l_orderkey, kind, CASE WHEN value IS NULL THEN 'unknown' ELSE 'known' END AS state, round(value, 2) AS value FROM u"""
)
def tradeoff_facts_long(t: Tables) -> DataFrame:
    parts = t.lineitem.select(
        "l_orderkey", F.when(F.col("l_tax") < 0.078, F.col("l_extendedprice")).alias("cost"), (F.col("l_discount") * 100).alias("weight"),
        F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("unit"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("maker"),
        "l_linenumber", "l_discount",
    )
    counts = {"reuse_existing": F.when(F.col("l_linenumber") % 3 == 0, F.col("q")).otherwise(F.lit(0.0)), "selected_power_path_count": F.when(F.col("l_discount") < 0.09, F.col("l_linenumber"))}
    out = sel.tradeoff_facts(parts, ["l_orderkey"], {"purchase_cost": "cost", "weight": "weight"}, "q", "unit", "maker", counts)
    return out.select("l_orderkey", "kind", "state", F.round("value", 2).alias("value"))


@bind(
    """WITH p AS (SELECT l_orderkey, CASE WHEN l_discount < 0.02 THEN 'not_applicable' WHEN l_discount < 0.05 THEN 'absent' WHEN l_discount < 0.08 THEN 'known' ELSE 'unknown' END AS state,
  l_returnflag = 'A' AS v FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(state = 'known' AND v) THEN 'present' WHEN bool_and(state = 'not_applicable') THEN 'not_applicable'
  WHEN bool_and(state IN ('not_applicable', 'absent') OR (state = 'known' AND NOT v)) THEN 'absent' ELSE 'unknown' END AS capability FROM p GROUP BY 1"""
)
def optional_capability(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    state = F.when(d < 0.02, F.lit("not_applicable")).when(d < 0.05, F.lit("absent")).when(d < 0.08, F.lit("known")).otherwise(F.lit("unknown"))
    parts = t.lineitem.select("l_orderkey", state.alias("state"), (F.col("l_returnflag") == "A").alias("v"))
    return sel.optional_capability(parts, ["l_orderkey"], "state", "v")


_EVALUATED_AT = "2024-07-01 00:00:00"
#: Documents as evidence on their source: labels verify it, its language says what kind it is.
_EVIDENCE_SQL = """
ev AS (SELECT d.doc_id AS id, source, CASE lang WHEN 'en' THEN 'forum_report' WHEN 'fr' THEN 'news_report' WHEN 'de' THEN 'recall' ELSE 'service_bulletin' END AS type,
    CASE WHEN n_chars % 7 = 0 THEN 'closed' ELSE 'active' END AS status,
    CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'retracted' ELSE 'unverified' END AS vs, 'k' || (d.doc_id % 3) AS source_key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
ad AS (SELECT doc_id AS id, source, [doc_id, (doc_id + 1) % (SELECT count(*) FROM documents)] AS eids,
    CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'inform' WHEN 2 THEN 'caution' WHEN 3 THEN 'suppress_recommendation' ELSE 'exclude' END AS action,
    CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
    CASE WHEN doc_id % 11 = 0 THEN 'resolved' ELSE 'open' END AS status, TIMESTAMP '2024-01-01' + to_days((doc_id % 300)::INTEGER) AS updated_at,
    CASE WHEN doc_id % 6 = 0 THEN TIMESTAMP '2024-06-01' + to_days((doc_id % 90)::INTEGER) END AS next_review_at,
    CASE WHEN doc_id % 13 = 0 THEN 'caution' END AS reviewed_action FROM documents),
lk AS (SELECT ad.id, unnest(eids) AS eid FROM ad),
f AS (SELECT lk.id, count(*) AS n, bool_and(type IN ('forum_report', 'news_report')) AS weak,
    count(DISTINCT CASE WHEN vs = 'verified' AND type IN ('recall', 'service_bulletin') THEN source_key END) AS ind
  FROM lk JOIN ev ON ev.id = lk.eid WHERE ev.status = 'active' AND vs <> 'retracted' GROUP BY 1),
asd AS (SELECT ad.*, coalesce(n, 0) AS active_evidence, coalesce(n > 0 AND NOT weak AND ind > 0, false) AS strong,
    CASE WHEN n IS NULL OR weak THEN 'low' WHEN ind > 0 THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN n IS NULL THEN 'none' WHEN weak THEN CASE WHEN action IN ('none', 'inform') THEN action ELSE 'caution' END ELSE action END AS assessed
  FROM ad LEFT JOIN f USING (id)),
rk AS (SELECT source, CASE WHEN status = 'resolved' THEN 0 ELSE CASE coalesce(reviewed_action, assessed) WHEN 'none' THEN 0 WHEN 'inform' THEN 1 WHEN 'caution' THEN 2
      WHEN 'suppress_recommendation' THEN 3 ELSE 4 END END AS a,
    CASE severity WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS s, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS c,
    (epoch_us(TIMESTAMP '2024-07-01') - epoch_us(updated_at)) / 86400e6 > 170 AS stale,
    coalesce((epoch_us(TIMESTAMP '2024-07-01') - epoch_us(next_review_at)) / 86400e6 >= 0, false) AS due FROM asd),
cv AS (SELECT source AS component_id, count(*) AS advisories, ['none', 'inform', 'caution', 'suppress_recommendation', 'exclude'][max(a) + 1] AS policy_action,
    ['informational', 'low', 'moderate', 'high', 'critical'][max(s) + 1] AS severity, ['low', 'medium', 'high'][max(c) + 1] AS confidence,
    bool_or(stale) AS stale, bool_or(due) AS review_due FROM rk GROUP BY 1)
"""


def _assessed(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    n = docs.count()
    marks = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    lang, q, i = F.col("lang"), F.col("quality"), F.col("doc_id")
    evidence = docs.join(marks, "doc_id", "left").select(
        i.alias("id"),
        F.when(lang == "en", F.lit("forum_report")).when(lang == "fr", F.lit("news_report")).when(lang == "de", F.lit("recall")).otherwise(F.lit("service_bulletin")).alias("type"),
        F.when(F.col("n_chars") % 7 == 0, F.lit("closed")).otherwise(F.lit("active")).alias("status"),
        F.when(q == 1, F.lit("verified")).when(q == 0, F.lit("retracted")).otherwise(F.lit("unverified")).alias("verification_status"),
        F.concat(F.lit("k"), (i % 3).cast("string")).alias("source_key"),
    )
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    plus = lambda start, d: F.to_timestamp(F.lit(start)) + F.make_dt_interval(d.cast("int"))
    none = F.lit(None).cast("string")
    advisories = docs.select(
        i.alias("id"),
        F.array("source").alias("affected_component_ids"),
        F.array(i, (i + 1) % n).alias("evidence_ids"),
        pick(["none", "inform", "caution", "suppress_recommendation", "exclude"]).alias("policy_action"),
        pick(["low", "moderate", "high", "critical"]).alias("severity"),
        F.when(i % 11 == 0, F.lit("resolved")).otherwise(F.lit("open")).alias("status"),
        plus("2024-01-01", i % 300).alias("updated_at"),
        F.when(i % 6 == 0, plus("2024-06-01", i % 90)).alias("next_review_at"),
        F.lit(None).cast("timestamp").alias("review_after"),
        F.when(i % 13 == 0, F.lit("caution")).alias("reviewed_action"),
        none.alias("reviewed_status"), none.alias("reviewed_severity"), none.alias("reviewed_confidence"),
    )
    return adv.assess(advisories, evidence)


def _components(t: Tables) -> DataFrame:
    return adv.evaluate_components(_assessed(t), F.to_timestamp(F.lit(_EVALUATED_AT)), 170.0)


@bind(
    f"WITH {_EVIDENCE_SQL} SELECT id AS advisory_id, active_evidence, CASE WHEN strong THEN 'sufficient' ELSE 'needs_review' END AS assessed_status, confidence AS assessed_confidence, assessed AS assessed_action FROM asd"
)
def advisory_assessment(t: Tables) -> DataFrame:
    return _assessed(t).select(F.col("id").alias("advisory_id"), "active_evidence", "assessed_status", "assessed_confidence", "assessed_action")


@bind(f"WITH {_EVIDENCE_SQL} SELECT * FROM cv")
def advisory_effective(t: Tables) -> DataFrame:
    return _components(t)


@bind(
    f"""WITH {_EVIDENCE_SQL}, c AS (SELECT DISTINCT source, CASE WHEN source IN ('src1', 'src2') THEN 'unknown' ELSE 'compatible' END AS engineering_status FROM documents)
SELECT source, engineering_status, coalesce(policy_action, 'none') AS policy_action,
  engineering_status = 'compatible' AND coalesce(policy_action, 'none') NOT IN ('exclude', 'suppress_recommendation') AS recommended,
  engineering_status = 'compatible' AND coalesce(policy_action, 'none') = 'suppress_recommendation' AS inspectable FROM c LEFT JOIN cv ON component_id = source"""
)
def advisory_boundary(t: Tables) -> DataFrame:
    status = F.when(F.col("source").isin("src1", "src2"), F.lit("unknown")).otherwise(F.lit("compatible"))
    candidates = t.documents.select("source").distinct().withColumn("engineering_status", status)
    return adv.recommendation_boundary(candidates, _components(t), "source")


_OVERLAY_SQL = """
cat AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'stocked' WHEN 1 THEN 'special_order' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'discontinued' WHEN 4 THEN 'unknown' ELSE 'stocked' END AS availability,
  CASE p_size % 3 WHEN 0 THEN 'preferred' WHEN 1 THEN 'standard' ELSE 'discouraged' END AS preference FROM part WHERE p_size > 10),
ov AS (SELECT part.p_partkey, p_brand, CASE WHEN availability IS NULL OR availability IN ('unavailable', 'discontinued') THEN 'ineligible'
    WHEN availability IN ('stocked', 'special_order') THEN 'eligible' ELSE 'unknown' END AS status,
  CASE WHEN availability IS NULL THEN 'builder.catalog_missing' WHEN availability = 'unknown' THEN 'builder.availability_unknown' ELSE 'builder.' || availability END AS reason,
  CASE WHEN availability IS NULL OR availability NOT IN ('stocked', 'special_order') THEN 999 WHEN preference = 'discouraged' THEN 5
    ELSE CASE availability WHEN 'stocked' THEN 0 ELSE 2 END + CASE preference WHEN 'preferred' THEN 0 ELSE 1 END END AS rank
  FROM part LEFT JOIN cat USING (p_partkey))
"""


def _overlaid(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    catalog = t.part.where(s > 10).select(
        "p_partkey",
        pick(["stocked", "special_order", "unavailable", "discontinued", "unknown", "stocked"], k).alias("availability"),
        pick(["preferred", "standard", "discouraged"], s).alias("preference"),
    )
    return adv.catalog_overlay(t.part.select("p_partkey", "p_brand"), catalog, "p_partkey")


@bind(f"WITH {_OVERLAY_SQL} SELECT p_partkey, status, reason, rank FROM ov")
def catalog_overlay_rank(t: Tables) -> DataFrame:
    return _overlaid(t).select("p_partkey", "status", "reason", "rank")


@bind(
    f"""WITH {_OVERLAY_SQL} SELECT p_brand, CASE WHEN bool_or(status = 'eligible') THEN 'eligible' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'inventory_gap' END AS outcome,
  count(*) FILTER (status = 'eligible') AS eligible, count(*) AS candidates FROM ov GROUP BY 1"""
)
def catalog_outcome(t: Tables) -> DataFrame:
    return adv.overlay_outcome(_overlaid(t), ["p_brand"])


_CLAIMS_SQL = """
cl AS (SELECT conv_id, turn // 2 AS term, role, turn AS participant FROM conversations),
sd AS (SELECT conv_id, term, count(*) FILTER (role = 'assistant') AS exposers, count(*) FILTER (role <> 'assistant') AS consumers,
  min(participant) FILTER (role = 'assistant') AS s, min(participant) FILTER (role <> 'assistant') AS c FROM cl GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN exposers > 1 AND consumers > 0 THEN 'ambiguous_information_source' WHEN exposers = 1 AND consumers = 1 AND s <> c THEN 'paired' ELSE 'none' END AS code FROM sd)
"""


def _claims(t: Tables) -> DataFrame:
    claims = t.conversations.select("conv_id", F.floor(F.col("turn") / 2).alias("term"), "role", F.col("turn").alias("participant"))
    return links.claim_pairs(claims, "conv_id", "term", "role", "assistant", "participant")


@bind(
    f"""WITH {_CLAIMS_SQL} SELECT conv_id, term, exposers, consumers, code, CASE WHEN code = 'paired' THEN s ELSE -1 END AS source, CASE WHEN code = 'paired' THEN c ELSE -1 END AS consumer FROM pr"""
)
def comm_pairs(t: Tables) -> DataFrame:
    return _claims(t).select("conv_id", "term", "exposers", "consumers", "code", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("source", "consumer")])


@bind(
    f"""WITH {_CLAIMS_SQL}, rq AS (SELECT DISTINCT conv_id, k.t AS term FROM conversations, range(0, 3) k(t))
SELECT conv_id, term, CASE WHEN bool_or(code = 'paired') THEN 'satisfied' ELSE 'unknown' END AS status FROM rq LEFT JOIN pr USING (conv_id, term) GROUP BY 1, 2"""
)
def requirement_match(t: Tables) -> DataFrame:
    needs = t.conversations.select("conv_id").distinct().withColumn("term", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    facts = _claims(t).where(F.col("code") == "paired")
    return links.requirement_match(needs, facts, ["conv_id", "term"])


@bind(
    """WITH o AS (SELECT 'order_without_customer' AS code, o_custkey + 3 AS r FROM orders), l AS (SELECT 'line_without_part' AS code, l_partkey + 5 AS r FROM lineitem)
SELECT code, r::VARCHAR AS reference, count(*) AS rows FROM (SELECT * FROM o WHERE r NOT IN (SELECT c_custkey FROM customer) UNION ALL
  SELECT * FROM l WHERE r NOT IN (SELECT p_partkey FROM part)) GROUP BY 1, 2"""
)
def referential_issues(t: Tables) -> DataFrame:
    """Keys are shifted, as the tables themselves have no dangling reference."""
    orders = t.orders.select((F.col("o_custkey") + 3).alias("ref"))
    lines = t.lineitem.select((F.col("l_partkey") + 5).alias("ref"))
    return links.referential_issues(
        [("order_without_customer", orders, "ref", t.customer, "c_custkey"), ("line_without_part", lines, "ref", t.part, "p_partkey")]
    )


@bind(
    """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 5 THEN c_custkey WHEN c_custkey > 0 THEN c_custkey // 2 END AS parent FROM customer),
x AS (SELECT id, CASE WHEN EXISTS (SELECT 1 FROM n m WHERE m.id = n.parent) OR parent IS NULL THEN parent END AS parent FROM n),
w AS (SELECT id, id AS at, 0 AS d FROM x UNION ALL SELECT w.id, x.parent, d + 1 FROM w JOIN x ON x.id = w.at WHERE x.parent IS NOT NULL AND d < 40)
SELECT id AS c_custkey, max(d) >= 40 AS cyclic FROM w GROUP BY 1"""
)
def cycle_detect(t: Tables) -> DataFrame:
    """Parents are key / 2, but some nodes are their own parent; parents that do not exist are none."""
    k = F.col("c_custkey")
    nodes = t.customer.select(k, F.when(k % 97 == 5, k).when(k > 0, F.floor(k / 2)).alias("parent"))
    there = nodes.select(k.alias("parent"), F.lit(True).alias("_there"))
    nodes = nodes.join(there, "parent", "left").select("c_custkey", F.when(F.col("_there"), F.col("parent")).alias("parent"))
    return links.cyclic_nodes(nodes, "c_custkey", "parent")
