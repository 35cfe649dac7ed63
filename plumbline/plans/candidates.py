"""Architecture candidates, bound to orders as projects and their lines as loads and charging sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import architectures as arch
from ..sources.storage import cut
from ._registry import Tables, bind

_GIVEN = """WITH p AS (SELECT o_orderkey AS project, CASE o_orderpriority WHEN '1-URGENT' THEN 24.0 WHEN '2-HIGH' THEN 36.0 END AS fixed FROM orders),
n AS (SELECT l_orderkey AS project, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
l AS (SELECT project, id, l_partkey % 4 = 0 AS ac, CASE WHEN l_partkey % 8 = 0 THEN 230.0 WHEN l_partkey % 8 = 4 THEN 120.0 WHEN l_partkey % 4 = 1 THEN 12.0 WHEN l_partkey % 4 = 2 THEN 24.0 END AS v,
  CASE WHEN l_partkey % 4 = 0 AND l_suppkey % 7 <> 0 THEN 60.0 END AS f, l_quantity = 50 AS alone, CASE WHEN l_discount < 0.1 THEN l_quantity * 10 END AS w FROM n WHERE l_linenumber < 6),
m AS (SELECT *, CASE WHEN ac THEN 'ac' ELSE 'dc' END || ':' || coalesce(v::DOUBLE::VARCHAR, 'unknown') || ':' || coalesce(f::DOUBLE::VARCHAR, 'unknown')
  || CASE WHEN v IS NULL OR alone OR (ac AND f IS NULL) THEN '#' || id ELSE '' END AS grp FROM l),
g AS (SELECT project, grp, any_value(ac) AS ac, any_value(v) AS v, bool_or(alone) AS alone, count(*) AS loads, count(*) - count(w) AS unknown, max(w) AS least FROM m GROUP BY 1, 2),
s AS (SELECT project, id, l_partkey % 3 AS k, l_tax = 0.08 AS odd, l_partkey % 3 = 2 AND l_suppkey % 5 = 0 AS blank FROM n WHERE l_linenumber >= 6),
c AS (SELECT p.project, v.v AS house, a.a AS arrangement FROM p, unnest([12.0, 24.0, 36.0, 48.0]) v(v), unnest(['separate', 'combined']) a(a)
  WHERE CASE WHEN fixed IS NULL THEN v.v <> 36 ELSE v.v = fixed END
  AND (a.a = 'separate' OR ((SELECT count(*) FROM g WHERE g.project = p.project AND g.ac) = 1 AND (SELECT count(*) FROM s WHERE s.project = p.project AND s.k = 0) = 1))),
u AS (SELECT c.house, c.arrangement, g.project AS grp_project, g.* EXCLUDE (project), CASE WHEN g.ac THEN CASE WHEN arrangement = 'combined' THEN 'inverter_charger' ELSE 'inverter' END WHEN alone OR v <> house THEN 'dc_conversion' END AS fn FROM c JOIN g ON g.project = c.project)
"""


def _given(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    priority = F.col("o_orderpriority")
    projects = t.orders.select(F.col("o_orderkey").alias("project"), F.when(priority == "1-URGENT", 24.0).when(priority == "2-HIGH", 36.0).alias("fixed_voltage"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    asked = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    # read by every bound, group and route: numbered once
    lines = cut(t.lineitem.select(F.col("l_orderkey").alias("project"), *asked, rank.alias("id")))
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    loads = lines.where(F.col("l_linenumber") < 6).select(
        "project", F.col("id").alias("load"), F.when(part % 4 == 0, "ac").otherwise("dc").alias("kind"),
        F.when(part % 8 == 0, 230.0).when(part % 8 == 4, 120.0).when(part % 4 == 1, 12.0).when(part % 4 == 2, 24.0).alias("voltage"),
        F.when((part % 4 == 0) & (supplier % 7 != 0), 60.0).alias("frequency"), F.when(F.col("l_discount") < 0.1, F.col("l_quantity") * 10).alias("power_w"),
        (F.col("l_quantity") == 50).alias("isolated"),
    )
    kind = F.when(part % 3 == 0, "shore").when(part % 3 == 1, "solar").otherwise("vehicle")
    usual = F.when(part % 3 == 0, "ac").when(part % 3 == 1, "pv_dc").otherwise("dc")
    sources = lines.where(F.col("l_linenumber") >= 6).select(
        "project", F.col("id").alias("source"), kind.alias("source_kind"), F.when(F.col("l_tax") == 0.08, "dc").otherwise(usual).alias("kind"),
        F.when((part % 3 == 2) & (supplier % 5 == 0), None).otherwise(F.lit(120.0)).alias("voltage"),
    )
    return projects, loads, sources


@bind(
    _GIVEN
    + """, r AS (
  SELECT grp_project AS project, house, arrangement, CASE WHEN v IS NULL OR unknown > 0 OR (fn IS NOT NULL AND loads > 1) THEN 1 ELSE 0 END AS rank FROM u
  UNION ALL SELECT c.project, c.house, c.arrangement, CASE WHEN odd AND k <> 2 THEN 2 WHEN blank THEN 1 ELSE 0 END FROM c JOIN s ON s.project = c.project
  UNION ALL SELECT project, house, arrangement, CASE WHEN house = 36 THEN 2 ELSE 0 END FROM c
  UNION ALL SELECT project, house, arrangement, 0 FROM c)
SELECT project, house::DOUBLE AS house_voltage, arrangement, CASE max(rank) WHEN 2 THEN 'blocked' WHEN 1 THEN 'unresolved' ELSE 'eligible' END AS status, count(*) AS roles,
  count(*) FILTER (rank = 2) AS blocked, count(*) FILTER (rank = 1) AS unresolved FROM r GROUP BY 1, 2, 3"""
)
def architecture_status(t: Tables) -> DataFrame:
    projects, loads, sources = _given(t)
    candidates = arch.architecture_candidates(projects, loads, sources)
    return arch.candidate_status(arch.candidate_roles(candidates, loads, sources))


@bind(
    _GIVEN
    + """, h AS (SELECT u.grp_project AS project, u.house, u.arrangement, u.grp, u.fn, m.id FROM u JOIN m ON m.project = u.grp_project AND m.grp = u.grp),
a AS (SELECT project, min(grp) AS grp FROM g WHERE ac GROUP BY 1),
q AS (SELECT c.project, c.house, c.arrangement, s.id, CASE WHEN k = 0 AND c.arrangement = 'combined' THEN 'conversion.' || a.grp ELSE 'charging.' || s.id END AS role FROM c JOIN s ON s.project = c.project LEFT JOIN a ON a.project = c.project),
e AS (
  SELECT project, house, arrangement, 'supply.' || id AS route, 0 AS step, 'house' AS from_node, CASE WHEN fn IS NULL THEN 'domain.' || grp ELSE 'conversion.' || grp || '.dc' END AS to_node, 'wire' AS kind FROM h
  UNION ALL SELECT project, house, arrangement, 'supply.' || id, 1, 'conversion.' || grp || '.dc', 'conversion.' || grp || '.output', 'path' FROM h WHERE fn IS NOT NULL
  UNION ALL SELECT project, house, arrangement, 'supply.' || id, 2, 'conversion.' || grp || '.output', 'domain.' || grp, 'wire' FROM h WHERE fn IS NOT NULL
  UNION ALL SELECT project, house, arrangement, 'supply.' || id, CASE WHEN fn IS NULL THEN 1 ELSE 3 END, 'domain.' || grp, 'demand.' || id, 'wire' FROM h
  UNION ALL SELECT project, house, arrangement, 'charge.' || id, 0, 'domain.source.' || id, role || '.input', 'wire' FROM q
  UNION ALL SELECT project, house, arrangement, 'charge.' || id, 1, role || '.input', role || '.dc', 'path' FROM q
  UNION ALL SELECT project, house, arrangement, 'charge.' || id, 2, role || '.dc', 'house', 'wire' FROM q
  UNION ALL SELECT project, house, arrangement, 'storage.discharge', 0, 'storage.port', 'house', 'wire' FROM c
  UNION ALL SELECT project, house, arrangement, 'storage.charge', 0, 'house', 'storage.port', 'wire' FROM c)
SELECT project, house::DOUBLE AS house_voltage, arrangement, route, step, from_node, to_node, kind FROM e"""
)
def architecture_edges(t: Tables) -> DataFrame:
    projects, loads, sources = _given(t)
    return arch.candidate_edges(arch.architecture_candidates(projects, loads, sources), loads, sources)
