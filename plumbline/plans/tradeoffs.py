"""Trade-off facts, bound to the supplied tables: orders are options, their lines the selected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tradeoffs
from ._registry import Tables, bind

_ASKED = ["optional_capability.communication", "optional_capability.monitoring", "optional_feature.quiet"]
_TIERS = [[("optional_capability.monitoring", True), ("reuse_existing", True)], [("component_count", False), ("weight", False)], [("purchase_cost", False)]]

_FACTS_SQL = """
r AS (SELECT p_partkey, p_partkey % 29 <> 0 AS ok, CASE WHEN p_size % 10 <> 0 THEN p_size::DOUBLE END AS weight, nullif(p_type, 'PROMO') AS dims,
  CASE WHEN p_partkey % 31 <> 0 THEN p_brand END AS maker, CASE WHEN p_partkey % 37 <> 0 THEN p_retailprice END AS amount,
  CASE WHEN p_partkey % 37 <> 0 THEN CASE WHEN p_size % 12 = 0 THEN 'EUR' ELSE 'USD' END END AS currency,
  CASE WHEN p_size > 25 THEN true WHEN p_size > 5 THEN false END AS monitoring, CASE WHEN p_name LIKE '%a%' THEN true WHEN p_name LIKE '%e%' THEN false END AS communication,
  CASE p_size % 6 WHEN 0 THEN 'known' WHEN 1 THEN 'absent' WHEN 2 THEN 'not_applicable' END AS quiet, p_size % 12 = 0 AS quiet_value, p_size % 25 = 3 AS odd FROM part),
l AS (SELECT l_orderkey AS o, l_linenumber AS role, l_partkey AS c, l_quantity AS q, r.*, l_linenumber % 3 = 0 AS reused, l_suppkey % 4 AS paths,
  bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey, l_linenumber) AS mine, bool_or(odd) OVER (PARTITION BY l_orderkey) AS odd_here FROM lineitem JOIN r ON p_partkey = l_partkey),
f AS (SELECT o, role, c, q, unnest([
    {'kind': 'weight', 'state': CASE WHEN ok AND weight IS NOT NULL THEN 'known' ELSE 'unknown' END, 'reason': CASE WHEN ok THEN 'weight_missing' ELSE 'canonical_record_not_verified' END, 'value': weight, 'text': NULL::VARCHAR, 'unit': 'kg'},
    {'kind': 'dimensions', 'state': CASE WHEN ok AND dims IS NOT NULL THEN 'known' ELSE 'unknown' END, 'reason': CASE WHEN ok THEN 'dimensions_missing' ELSE 'canonical_record_not_verified' END, 'value': NULL, 'text': dims, 'unit': 'mm'},
    {'kind': 'manufacturer', 'state': CASE WHEN maker IS NOT NULL THEN 'known' ELSE 'unknown' END, 'reason': 'manufacturer_missing', 'value': NULL, 'text': maker, 'unit': NULL},
    {'kind': 'physical_quantity', 'state': 'known', 'reason': NULL, 'value': q, 'text': NULL, 'unit': 'count'},
    {'kind': 'fixed_existing_quantity', 'state': 'known', 'reason': NULL, 'value': CASE WHEN reused THEN q ELSE 0 END, 'text': NULL, 'unit': 'count'},
    {'kind': 'selected_power_paths', 'state': 'known', 'reason': NULL, 'value': paths, 'text': NULL, 'unit': 'count'},
    {'kind': 'purchase_cost', 'state': CASE WHEN mine OR amount IS NOT NULL THEN 'known' ELSE 'unknown' END, 'reason': 'purchase_cost_missing', 'value': CASE WHEN mine THEN 0 ELSE amount END, 'text': NULL, 'unit': CASE WHEN mine THEN 'USD' ELSE currency END},
    {'kind': 'optional_capability.communication', 'state': CASE WHEN NOT ok OR communication IS NULL THEN 'unknown' WHEN communication THEN 'known' ELSE 'absent' END, 'reason': CASE WHEN ok THEN 'optional_capability_unknown' ELSE 'canonical_record_not_verified' END, 'value': 1, 'text': NULL, 'unit': NULL},
    {'kind': 'optional_capability.monitoring', 'state': CASE WHEN NOT ok OR monitoring IS NULL THEN 'unknown' WHEN monitoring THEN 'known' ELSE 'absent' END, 'reason': CASE WHEN ok THEN 'optional_capability_unknown' ELSE 'canonical_record_not_verified' END, 'value': 1, 'text': NULL, 'unit': NULL},
    {'kind': 'optional_feature.quiet', 'state': coalesce(quiet, 'unknown'), 'reason': 'optional_feature_unknown', 'value': quiet_value::INTEGER, 'text': NULL, 'unit': NULL},
    {'kind': CASE WHEN odd_here THEN 'optional_feature.odd' END, 'state': CASE WHEN odd THEN 'known' ELSE 'unknown' END, 'reason': 'optional_feature_unknown', 'value': 1, 'text': NULL, 'unit': NULL},
    {'kind': CASE WHEN dims LIKE '%TIN' THEN 'qualified_dimensions.body' END, 'state': CASE WHEN ok THEN 'known' ELSE 'unknown' END, 'reason': 'canonical_record_not_verified', 'value': NULL, 'text': dims, 'unit': 'mm'}], recursive := true) FROM l),
g AS (SELECT o AS option, role, c AS component, q AS quantity, kind, state, CASE WHEN state IN ('unknown', 'not_applicable') THEN reason END AS reason,
  CASE WHEN state = 'known' THEN value END AS value, CASE WHEN state = 'known' THEN text END AS text, unit FROM f WHERE kind IS NOT NULL)
"""
_SYSTEM_SQL = f"""
{_FACTS_SQL},
n AS (SELECT o_orderkey AS option FROM orders),
s AS (SELECT option, kind, unit, sum(value * quantity) AS subtotal FROM g WHERE kind IN ('weight', 'purchase_cost') AND value IS NOT NULL AND unit IS NOT NULL GROUP BY ALL),
su AS (SELECT option, kind, count(*) AS units, sum(subtotal) AS total, max(unit) AS unit FROM s GROUP BY ALL),
op AS (SELECT option, kind, count(*) AS n, count(*) FILTER (value IS NULL) AS open FROM g WHERE kind IN ('weight', 'purchase_cost') GROUP BY ALL),
tt AS (SELECT n.option, k.kind, CASE WHEN op.n IS NULL AND k.kind = 'weight' THEN 0 WHEN units = 1 AND open = 0 THEN total END AS value,
  CASE WHEN units > 1 THEN 'mixed_currency' WHEN open > 0 THEN 'comparison_incomplete' ELSE 'cost_currency_missing' END AS reason,
  coalesce(CASE WHEN units = 1 THEN su.unit END, CASE WHEN k.kind = 'weight' THEN 'kg' END) AS unit, coalesce(open + CASE WHEN units > 1 THEN op.n ELSE 0 END, 0) AS unresolved
  FROM n CROSS JOIN (VALUES ('weight'), ('purchase_cost')) k(kind) LEFT JOIN op ON op.option = n.option AND op.kind = k.kind LEFT JOIN su ON su.option = n.option AND su.kind = k.kind),
cc AS (SELECT n.option, m.kind, coalesce(sum(value), 0) AS value FROM n CROSS JOIN (VALUES ('component_count', 'physical_quantity'), ('reuse_existing', 'fixed_existing_quantity'), ('selected_power_path_count', 'selected_power_paths')) m(kind, part)
  LEFT JOIN g ON g.option = n.option AND g.kind = m.part GROUP BY ALL),
mm AS (SELECT n.option, count(DISTINCT text) AS makers, count(*) FILTER (state <> 'known') AS open FROM n LEFT JOIN g ON g.option = n.option AND g.kind = 'manufacturer' GROUP BY ALL),
k AS (SELECT option, kind FROM g WHERE kind LIKE 'optional%' UNION SELECT option, kind FROM n CROSS JOIN (VALUES ('optional_capability.communication'), ('optional_capability.monitoring'), ('optional_feature.quiet')) v(kind)),
oo AS (SELECT k.option, k.kind, count(*) FILTER (state = 'known' AND value = 1) > 0 AS hit, count(*) FILTER (state <> 'not_applicable') AS applicable,
  count(*) FILTER (state = 'absent' OR (state = 'known' AND value = 0)) AS lack, count(*) FILTER (state = 'unknown') AS open FROM k LEFT JOIN g ON g.option = k.option AND g.kind = k.kind GROUP BY ALL),
aa AS (SELECT n.option, count(DISTINCT component) AS v FROM n LEFT JOIN g ON g.option = n.option AND component % 5 <> 0 GROUP BY ALL),
sf AS (SELECT option, kind, CASE WHEN value IS NULL THEN 'unknown' ELSE 'known' END AS state, CASE WHEN value IS NULL THEN reason END AS reason, round(value, 2) AS value, unit, unresolved FROM tt
UNION ALL SELECT option, kind, 'known', NULL, value, 'count', 0 FROM cc
UNION ALL SELECT option, 'manufacturer_count', CASE WHEN open = 0 THEN 'known' ELSE 'unknown' END, CASE WHEN open > 0 THEN 'manufacturer_missing' END, CASE WHEN open = 0 THEN makers END, 'count', open FROM mm
UNION ALL SELECT option, kind, CASE WHEN hit THEN 'known' WHEN applicable = 0 THEN 'not_applicable' WHEN lack = applicable THEN 'absent' ELSE 'unknown' END,
  CASE WHEN hit OR (lack = applicable AND applicable > 0) THEN NULL WHEN applicable = 0 THEN 'no_applicable_selected_component' ELSE 'optional_capability_unknown' END, CASE WHEN hit THEN 1 END, NULL, open FROM oo
UNION ALL SELECT option, 'advisory_context', 'known', NULL, v, NULL, 0 FROM aa)
"""


def _component_facts(t: Tables, kinds: list[str] | None = None) -> DataFrame:
    k, size, name = F.col("component"), F.col("p_size"), F.col("p_name")
    part = t.part.withColumnRenamed("p_partkey", "component")
    dims = F.nullif(F.col("p_type"), F.lit("PROMO"))
    records = part.select(
        "component", (k % 29 != 0).alias("verified"), F.when(size % 10 != 0, size.cast("double")).alias("weight"), dims.alias("dimensions"),
        F.when(k % 31 != 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("maker"),
    )
    currency = F.when(size % 12 == 0, F.lit("EUR")).otherwise(F.lit("USD"))
    # the second offer of each part is dearer and does not count
    offers = F.array(F.struct(F.lit(0).alias("place"), F.col("p_retailprice").alias("amount")), F.struct(F.lit(1).alias("place"), F.lit(1e9).alias("amount")))
    prices = part.where(k % 37 != 0).select("component", currency.alias("currency"), F.inline(offers))
    told = F.create_map(
        F.lit("monitoring"), F.when(size > 25, True).when(size > 5, False), F.lit("communication"), F.when(name.contains("a"), True).when(name.contains("e"), False),
        F.lit("unasked"), F.lit(True),
    )
    capabilities = part.select("component", F.explode(told).alias("capability", "present")).where("present is not null")
    states = F.when(size % 6 == 0, F.lit("known")).when(size % 6 == 1, F.lit("absent")).when(size % 6 == 2, F.lit("not_applicable"))
    quiet = part.select("component", F.lit("quiet").alias("feature"), F.lit(0).alias("place"), states.alias("state"), (size % 12 == 0).alias("value")).where("state is not null")
    odd = part.where(size % 25 == 3).select("component", F.lit("odd").alias("feature"), F.lit(0).alias("place"), F.lit("known").alias("state"), F.lit(True).alias("value"))
    bindings = t.lineitem.select(
        F.col("l_orderkey").alias("option"), F.col("l_linenumber").alias("role"), F.col("l_partkey").alias("component"), F.col("l_quantity").alias("quantity"),
        (F.col("l_linenumber") % 3 == 0).alias("reused"), (F.col("l_suppkey") % 4).alias("paths"),
    )
    owned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("option"), F.col("l_linenumber").alias("role"), F.lit("USD").alias("currency"))
    qualified = part.where(F.col("p_type").endswith("TIN")).select("component", F.lit("body").alias("assertion"), dims.alias("value"))
    told = (bindings, records, prices, owned, capabilities)
    if kinds is not None:
        return tradeoffs.component_columns(*told, kinds)
    return tradeoffs.component_facts(*told, quiet.unionByName(odd), ["monitoring", "communication"], ["quiet"], qualified)


def _system_facts(t: Tables) -> DataFrame:
    evaluated = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("component"))
    return tradeoffs.system_facts(t.orders.select(F.col("o_orderkey").alias("option")), _component_facts(t), _ASKED, evaluated)


@bind(f"WITH {_FACTS_SQL} SELECT option, role, component, quantity, kind, state, reason, value::DOUBLE AS value, text, unit FROM g")
def tradeoff_component_facts(t: Tables) -> DataFrame:
    return _component_facts(t)


@bind(f"WITH {_FACTS_SQL} SELECT option, kind, unit, round(sum(value * quantity), 2) AS subtotal FROM g WHERE kind IN ('weight', 'purchase_cost') AND value IS NOT NULL GROUP BY ALL")
def tradeoff_subtotals(t: Tables) -> DataFrame:
    return tradeoffs.subtotals(_component_facts(t)).withColumn("subtotal", F.round("subtotal", 2))


@bind(f"WITH {_SYSTEM_SQL} SELECT option, kind, state, reason, value::DOUBLE AS value, unit, unresolved FROM sf")
def tradeoff_system_facts(t: Tables) -> DataFrame:
    return _system_facts(t).withColumn("value", F.round("value", 2))


@bind(
    f"""WITH {_SYSTEM_SQL},
pp AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
cr(tier, kind, up) AS (VALUES (0, 'optional_capability.monitoring', true), (0, 'reuse_existing', true), (1, 'component_count', false), (1, 'weight', false), (2, 'purchase_cost', false)),
v AS (SELECT option, kind, state, unit, CASE WHEN state = 'absent' THEN 0 ELSE value END AS v FROM sf),
e AS (SELECT a, b, tier, cr.kind, CASE WHEN x.state = 'not_applicable' OR y.state = 'not_applicable' THEN 'not_applicable' WHEN x.v IS NULL OR y.v IS NULL THEN 'comparison_incomplete'
    WHEN x.unit IS DISTINCT FROM y.unit THEN 'unit_mismatch' WHEN x.v = y.v THEN 'equal' WHEN (x.v > y.v) = up THEN 'left_better' ELSE 'right_better' END AS reason
  FROM pp CROSS JOIN cr JOIN v x ON x.option = a AND x.kind = cr.kind JOIN v y ON y.option = b AND y.kind = cr.kind WHERE b IS NOT NULL),
w AS (SELECT a, b, tier, count(*) FILTER (reason IN ('not_applicable', 'comparison_incomplete', 'unit_mismatch')) AS i, count(*) FILTER (reason = 'left_better') AS p, count(*) FILTER (reason = 'right_better') AS l FROM e GROUP BY ALL),
d AS (SELECT a, b, min(tier) AS tier FROM w WHERE i > 0 OR p > 0 OR l > 0 GROUP BY ALL)
SELECT e.a, e.b, e.tier, e.kind, CASE e.reason WHEN 'equal' THEN 'tied' WHEN 'left_better' THEN 'preferred' WHEN 'right_better' THEN 'worse' ELSE 'incomparable' END AS relation, e.reason,
  CASE WHEN d.tier IS NULL THEN 'tied' WHEN w.i > 0 OR (w.p > 0 AND w.l > 0) THEN 'incomparable' WHEN w.p > 0 THEN 'preferred' ELSE 'worse' END AS verdict, d.tier AS decisive_tier
FROM e LEFT JOIN d USING (a, b) LEFT JOIN w ON w.a = d.a AND w.b = d.b AND w.tier = d.tier"""
)
def tradeoff_comparisons(t: Tables) -> DataFrame:
    """Each order of a customer against the customer's next one, criterion by criterion."""
    following = F.expr("lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    pairs = t.orders.select(F.col("o_orderkey").alias("a"), following.alias("b")).where("b is not null")
    kinds = [kind for tier in _TIERS for kind, _ in tier]
    options = t.orders.select(F.col("o_orderkey").alias("option"))
    rows = tradeoffs.system_columns(options, _component_facts(t, tradeoffs.parts_of(kinds)), kinds)
    rounded = {k: F.col(f"`{k}`").withField("value", F.round(F.col(f"`{k}`")["value"], 2)) for k in kinds}
    return tradeoffs.compared_columns(pairs, rows.withColumns(rounded), _TIERS)
