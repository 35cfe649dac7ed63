"""Reviewed interactions against installed ones, bound to the supplied tables: an order is a case, its lines the participants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interactions
from ..sources.storage import cut
from ._registry import Tables, bind

_SQL = """
rel AS (SELECT o_orderkey AS c, CASE o_orderkey % 20 WHEN 0 THEN 'provisional' WHEN 1 THEN 'conflicting' ELSE 'verified' END AS state,
  CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 'negative' ELSE 'positive' END AS assertion FROM orders),
l AS (SELECT l_orderkey AS c, l_linenumber AS p, first(l_partkey ORDER BY l_partkey) AS part, first(l_quantity ORDER BY l_partkey, l_quantity) AS q FROM lineitem GROUP BY ALL),
e AS (SELECT l.*, 'e' || (part % 3) AS e, CASE WHEN p % 2 = 1 THEN 'component' WHEN q = 48 THEN 'unresolved_external' ELSE 'interaction_endpoint' END AS ref FROM l),
m AS (SELECT c, p, CASE WHEN p % 2 = 1 AND q <> 3 THEN 'component_instance' ELSE 'interaction_endpoint' END AS kind, CASE WHEN q = 47 THEN 'x' ELSE p::VARCHAR END AS i,
  CASE WHEN kind = 'interaction_endpoint' THEN CASE WHEN q = 46 THEN 'e9' ELSE e END END AS ep, NULL AS a FROM e WHERE q <> 45
  UNION ALL SELECT c, 100, 'installed_artifact', NULL, NULL, 'box' FROM rel WHERE c % 4 <> 3),
ins AS (SELECT c, p::VARCHAR AS i, part + CASE WHEN q = 44 THEN 1 ELSE 0 END AS part FROM l),
pr AS (SELECT e.c, e.p::VARCHAR AS subject, CASE WHEN m.kind IS NULL THEN 'participant_mapping_missing' WHEN ref = 'unresolved_external' THEN 'unresolved_participant' WHEN ins.part IS NULL THEN 'participant_mapping_missing'
    WHEN ref = 'component' AND m.kind <> 'component_instance' THEN 'participant_target_kind_mismatch' WHEN ref = 'component' AND ins.part <> e.part THEN 'participant_component_mismatch'
    WHEN ref <> 'component' AND (ins.part <> e.part OR m.ep <> e.e OR part.p_partkey IS NULL) THEN 'participant_endpoint_mismatch' END AS code
  FROM e LEFT JOIN m ON m.c = e.c AND m.p = e.p LEFT JOIN ins ON ins.c = e.c AND ins.i = m.i LEFT JOIN part ON p_partkey = ins.part AND p_size <> 1 AND 'e' || (p_partkey % 3) = m.ep
  UNION ALL SELECT e.c, e.p::VARCHAR, 'participant_mapping_ambiguous' FROM e WHERE q = 50),
fw AS (SELECT c, p::VARCHAR AS i, NULL AS ep, CASE WHEN q < 42 THEN 'v1' ELSE 'v2' END AS v FROM l WHERE p = 1 AND q <> 2 UNION ALL SELECT c, '1', 'e1', 'v3' FROM l WHERE p = 1 AND q % 5 = 0),
ap AS (SELECT c, CASE WHEN c % 33 = 0 THEN 'other' ELSE 'firmware' END AS kind FROM rel WHERE c % 3 = 0),
ar AS (SELECT ap.c, 'f' AS subject, CASE WHEN any_value(ap.kind) = 'other' OR count(fw.v) = 0 THEN 'applicability_unknown' WHEN count(DISTINCT fw.v) > 1 THEN 'qualifier_conflicting' WHEN min(fw.v) <> 'v1' THEN 'applicability_mismatch' ELSE 'applicability_satisfied' END AS code
  FROM ap LEFT JOIN m ON m.c = ap.c AND m.p = 1 LEFT JOIN fw ON fw.c = ap.c AND fw.i = m.i AND (fw.ep IS NULL OR fw.ep = m.ep) GROUP BY 1),
tp AS (SELECT c, 'direct' AS form, 'd' AS t, CASE WHEN c % 9 = 4 THEN 'disconnected' ELSE 'connected' END AS state FROM rel WHERE c % 23 <> 0 UNION ALL SELECT c, 'network', 'n', 'connected' FROM rel WHERE c % 29 <> 0),
en AS (SELECT c, 'direct' AS form, p::VARCHAR AS i, e FROM e WHERE q <> 43 UNION ALL SELECT c, 'network', p::VARCHAR, e FROM e WHERE q <> 42),
se AS (SELECT rel.c, tp.form, tp.t, tp.state FROM rel LEFT JOIN tp ON tp.c = rel.c AND tp.form = CASE WHEN rel.c % 2 = 0 THEN 'direct' ELSE 'network' END),
tr AS (SELECT c, t AS subject, CASE WHEN state IS NULL THEN 'installed_relationship_missing' ELSE 'installed_relationship_' || state END AS code FROM se
  UNION ALL SELECT m.c, m.p::VARCHAR, 'topology_requirement_unknown' FROM m JOIN se ON se.c = m.c AND se.t IS NOT NULL WHERE kind = 'component_instance' AND NOT EXISTS (SELECT 1 FROM en WHERE en.c = m.c AND en.form = se.form AND en.i = m.i)),
live AS (SELECT c, assertion FROM rel WHERE state = 'verified' AND assertion IS NOT NULL AND c NOT IN (SELECT c FROM ar WHERE code <> 'applicability_satisfied')),
co AS (SELECT live.c, 'c' AS subject, CASE WHEN tp.state IS NULL OR (live.c % 5 = 0 AND tp.form <> 'direct') OR (live.c % 5 = 1 AND tp.form <> 'network')
    OR (SELECT count(DISTINCT m.p) FROM m JOIN en ON en.c = m.c AND en.i = m.i AND en.form = tp.form AND (m.ep IS NULL OR m.ep = en.e) WHERE m.c = live.c AND m.p IN (1, 2)) < 2
    THEN 'topology_requirement_unknown' WHEN tp.state = 'connected' THEN 'topology_requirement_satisfied' ELSE 'topology_requirement_not_satisfied' END AS code
  FROM live LEFT JOIN tp ON tp.c = live.c AND tp.form = CASE WHEN live.c % 2 = 0 THEN 'direct' ELSE 'network' END WHERE live.c % 3 <> 1),
cg AS (SELECT live.c, 'g' AS subject, CASE WHEN l.c IS NULL THEN 'configuration_unknown' WHEN l.q < 40 THEN 'configuration_satisfied' ELSE 'configuration_not_satisfied' END AS code
  FROM live LEFT JOIN m ON m.c = live.c AND m.p = 2 LEFT JOIN e l ON l.c = live.c AND l.p = 2 AND m.i = '2' AND m.ep = l.e WHERE live.c % 7 < 3),
cr AS (SELECT live.c, 'r' AS subject, CASE WHEN se.form = 'direct' OR (se.form IS NULL AND live.c % 2 = 0) THEN 'configuration_satisfied' ELSE 'configuration_unknown' END AS code FROM live JOIN se USING (c) WHERE live.c % 7 = 6 AND live.c % 2 = 0),
ci AS (SELECT live.c, 'i' AS subject, CASE WHEN m.a IS NOT NULL AND live.c % 8 < 6 AND live.c % 29 <> 0 THEN 'required_intermediate_present' ELSE 'required_intermediate_unknown' END AS code
  FROM live LEFT JOIN m ON m.c = live.c AND m.p = 100 WHERE live.c % 6 = 5),
r AS (SELECT * FROM pr WHERE code IS NOT NULL UNION ALL SELECT * FROM ar UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM co UNION ALL SELECT * FROM cg UNION ALL SELECT * FROM cr UNION ALL SELECT * FROM ci
  UNION ALL SELECT c, 'z', 'unresolved_prerequisite' FROM live WHERE c % 50 = 9
  UNION ALL SELECT c, NULL, CASE WHEN state = 'conflicting' THEN 'reviewed_evidence_conflicting' WHEN state <> 'verified' OR assertion IS NULL THEN 'reviewed_assertion_unknown' ELSE 'reviewed_assertion_' || assertion END FROM rel)
"""


def _tables(t: Tables) -> dict[str, DataFrame]:
    o, c, p, q = F.col("o_orderkey"), F.col("case"), F.col("participant"), F.col("q")
    orders = t.orders.select(o.alias("case"))
    # read by nearly every table below: made once
    lines = cut(
        t.lineitem.groupBy(F.col("l_orderkey").alias("case"), F.col("l_linenumber").cast("long").alias("participant"))
        .agg(F.min(F.struct("l_partkey", "l_quantity")).alias("s"))
        .select("case", "participant", F.col("s.l_partkey").alias("part"), F.col("s.l_quantity").alias("q"))
    ).withColumn("e", F.concat(F.lit("e"), F.col("part") % 3))
    state = F.when(o % 20 == 0, "provisional").when(o % 20 == 1, "conflicting").otherwise("verified")
    assertion = F.when(o % 17 == 1, "negative").when(o % 17 != 0, "positive")
    ref = F.when(p % 2 == 1, "component").when(q == 48, "unresolved_external").otherwise("interaction_endpoint")
    kind = F.when((p % 2 == 1) & (q != 3), "component_instance").otherwise("interaction_endpoint")
    none, instance = F.lit(None).cast("string"), F.when(q == 47, "x").otherwise(p.cast("string"))
    mapped = lines.where(q != 45).select(
        "case", "participant", F.lit(0).alias("place"), kind.alias("target_kind"), instance.alias("instance"), F.when(q == 46, "e9").otherwise(F.col("e")).alias("endpoint"), none.alias("artifact")
    )
    again = mapped.join(lines.where(q == 50).select("case", "participant"), ["case", "participant"], "left_semi").withColumn("place", F.lit(1))
    box = orders.where(c % 4 != 3).select("case", F.lit(100).cast("long"), F.lit(0), F.lit("installed_artifact"), none, none, F.lit("box"))
    firmware = lines.where((p == 1) & (q != 2)).select("case", F.lit("1").alias("instance"), none.alias("endpoint"), F.lit("firmware").alias("kind"), F.when(q < 42, "v1").otherwise("v2").alias("value"))
    third = lines.where((p == 1) & (q % 5 == 0)).select("case", F.lit("1"), F.lit("e1"), F.lit("firmware"), F.lit("v3"))
    form = F.when(c % 2 == 0, "direct").otherwise("network")
    name = F.when(c % 2 == 0, "d").otherwise("n")
    direct = orders.where(c % 23 != 0).select("case", F.lit("direct").alias("form"), F.lit("d").alias("topology"), F.when(c % 9 == 4, "disconnected").otherwise("connected").alias("state"))
    network = orders.where(c % 29 != 0).select("case", F.lit("network"), F.lit("n"), F.lit("connected"))
    ends = lambda off, f, n: lines.where(q != off).select("case", F.lit(f).alias("form"), F.lit(n).alias("topology"), p.cast("string").alias("instance"), F.col("e").alias("endpoint"))

    def prerequisite(where, name, kind, participant=None, b=None, needs=none, key=None, operator=None, value=None):
        return orders.where(where).select(
            "case", F.lit(name).alias("prerequisite"), F.lit(kind).alias("kind"), F.lit(participant).cast("long").alias("participant"), F.lit(b).cast("long").alias("participant_b"),
            needs.alias("needs"), F.lit(key).cast("string").alias("key"), F.lit(operator).cast("string").alias("operator"), F.lit(value).cast("string").alias("value"),
        )

    needs = F.when(c % 5 == 0, "direct").when(c % 5 == 1, "shared_network").otherwise("direct_or_shared_network")
    prerequisites = (
        prerequisite(c % 3 != 1, "c", "connection", 1, 2, needs)
        .unionByName(prerequisite(c % 7 < 3, "g", "configuration", 2, key="mode", operator="equals", value='"on"'))
        .unionByName(prerequisite((c % 7 == 6) & (c % 2 == 0), "r", "configuration", key="rate", operator="present"))
        .unionByName(prerequisite(c % 6 == 5, "i", "intermediate", 100))
        .unionByName(prerequisite(c % 50 == 9, "z", "other"))
    )
    modes = lines.where(p == 2).select(
        "case", F.lit(0).alias("place"), F.lit("mode").alias("key"), none.alias("relationship"), F.lit("2").alias("instance"), F.col("e").alias("endpoint"), F.when(q < 40, '"on"').otherwise('"off"').alias("value")
    )
    rates = orders.select("case", F.lit(0), F.lit("rate"), F.lit("d"), none, none, F.lit("9600"))
    return {
        "relationships": t.orders.select(o.alias("case"), state.alias("state"), assertion.alias("assertion")),
        "participants": lines.select("case", "participant", ref.alias("ref_kind"), F.col("part").alias("ref_component"), F.col("e").alias("ref_endpoint")),
        "mappings": mapped.union(again).union(box),
        "instances": lines.select("case", p.cast("string").alias("instance"), (F.col("part") + F.when(q == 44, 1).otherwise(0)).alias("component")),
        "endpoints": t.part.where("p_size <> 1").select(F.col("p_partkey").alias("component"), F.concat(F.lit("e"), F.col("p_partkey") % 3).alias("endpoint")),
        "applicability": orders.where(c % 3 == 0).select(
            "case", F.lit("f").alias("applicability"), F.lit(1).cast("long").alias("participant"), F.when(c % 33 == 0, "other").otherwise("firmware").alias("kind"), F.lit("v1").alias("value")
        ),
        "qualifiers": firmware.union(third),
        "topologies": direct.union(network),
        "ends": ends(43, "direct", "d").union(ends(42, "network", "n")),
        "selected": orders.select("case", form.alias("form"), name.alias("topology")),
        "prerequisites": prerequisites,
        "chosen": orders.select("case", F.lit("c").alias("prerequisite"), form.alias("form"), name.alias("topology")).union(orders.select("case", F.lit("i"), F.lit("network"), F.lit("n"))),
        "artifacts": orders.select("case", F.lit("box").alias("artifact")),
        "intermediates": orders.where(c % 8 < 6).select("case", F.lit("network").alias("form"), F.lit("n").alias("topology"), F.lit("box").alias("object")),
        "configurations": modes.union(rates),
    }


@bind(f"WITH {_SQL} SELECT c AS \"case\", subject, code FROM r")
def interaction_reasons(t: Tables) -> DataFrame:
    return interactions.evaluated(_tables(t))[0]


@bind(
    f"""WITH {_SQL},
k AS (SELECT c, count(*) AS reasons, count(*) FILTER (code IN ('applicability_unknown', 'qualifier_conflicting', 'unresolved_participant', 'unresolved_prerequisite', 'installed_relationship_missing')
    OR code LIKE 'participant_%' OR (code LIKE '%_unknown' AND code <> 'reviewed_assertion_unknown')) AS open, count(*) FILTER (code LIKE '%_not_satisfied' OR code LIKE '%_disconnected') AS failed FROM r GROUP BY 1)
SELECT c AS "case", CASE WHEN live.assertion IS NULL THEN 'unknown' WHEN failed > 0 OR live.assertion = 'negative' THEN 'not_satisfied' WHEN open = 0 THEN 'satisfied' ELSE 'unknown' END AS status, reasons, open, failed
FROM k LEFT JOIN live USING (c)"""
)
def interaction_verdicts(t: Tables) -> DataFrame:
    return interactions.evaluated(_tables(t))[1]


@bind(
    """WITH r AS (SELECT o_orderkey AS c, CASE o_orderkey % 9 WHEN 0 THEN 'provisional' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'draft' ELSE 'verified' END AS state,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'negative' ELSE 'positive' END AS assertion FROM orders),
i AS (SELECT l_orderkey AS c, bool_or(l_returnflag <> 'N') AS gives, bool_or(l_returnflag = 'N') AS takes FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey AS c, list('required_intermediate_not_in_participants:s' || l_suppkey ORDER BY l_linenumber, 's' || l_suppkey) AS lost FROM lineitem a WHERE l_quantity > 40
  AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_quantity < 30) GROUP BY 1)
SELECT c AS relationship, CASE WHEN state <> 'verified' OR assertion IS NULL THEN 'unknown' WHEN assertion = 'negative' THEN 'explicit_negative' ELSE 'positive' END AS status,
  CASE WHEN state IN ('provisional', 'conflicting') THEN 'relationship_' || state WHEN state <> 'verified' THEN 'relationship_unresolved' WHEN assertion IS NULL THEN 'relationship_assertion_missing'
    WHEN assertion = 'negative' THEN 'explicit_negative_assertion' ELSE 'positive_assertion' END AS reason,
  concat_ws('|', CASE WHEN state = 'verified' AND assertion IS NULL THEN 'relationship_assertion_missing' END, CASE WHEN gives IS NULL THEN 'assertion_content_unavailable' END,
    CASE WHEN gives AND NOT takes THEN 'consumption_not_established' END, array_to_string(lost, '|')) AS unresolved FROM r LEFT JOIN i USING (c) LEFT JOIN g USING (c)"""
)
def interaction_interpretation(t: Tables) -> DataFrame:
    o, c, ref = F.col("o_orderkey"), F.col("l_orderkey").alias("relationship"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("ref")
    state = F.when(o % 9 == 0, "provisional").when(o % 9 == 1, "conflicting").when(o % 9 == 2, "draft").otherwise("verified")
    relationships = t.orders.select(o.alias("relationship"), state.alias("state"), F.when(o % 5 == 1, "negative").when(o % 5 != 0, "positive").alias("assertion"))
    information = t.lineitem.select(c, F.when(F.col("l_returnflag") == "N", "consumes").otherwise("exposes").alias("direction"))
    participants = t.lineitem.where("l_quantity < 30").select(c, ref)
    needed = t.lineitem.where("l_quantity > 40").select(c, F.col("l_linenumber").alias("place"), ref)
    out = interactions.interpreted(relationships, information, participants, needed)
    return out.withColumn("unresolved", F.concat_ws("|", "unresolved"))
