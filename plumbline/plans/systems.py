"""Shared capacity, full compatibility, witnesses, rules, accounting, boxes and embedded data, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import battery, facts, links, ranges, sequences
from ..operators import power as pw
from ..operators import selection as sel
from ..sources import html, tables
from ._registry import Tables, bind

#: group_id, mode, battery_count, least_c, most_c, unit, limit, paths, excluded pairs, open conditions
_GROUPS = (
    ("ac", "F", None, None, None, "W", 60.0, "1 2 3", "1/2", False),
    ("ac", "O", 1, None, None, "W", 80.0, "1 2 3", "", False),
    ("ac", "O", 2, None, None, "W", 120.0, "1 2 3 4", "3/4", False),
    ("ac", "O", 2, None, None, "W", 90.0, "1", "", False),
    ("dc", "O", None, -5.0, 25.0, "W", 50.0, "2 4", "", False),
    ("dc", "F", None, 0.0, None, "VA", 40.0, "4 5", "4/5", False),
    ("aux", "P", None, None, None, "W", 70.0, "1 2 3 4 5 6 7", "1/7 2/3", False),
    ("aux", "F", None, None, None, "W", 70.0, "6", "", True),
)
_text = lambda x: "NULL" if x is None else f"'{x}'"
_number = lambda x: "NULL" if x is None else str(x)
_GROUPS_SQL = ", ".join(
    f"({_text(i)}, {_text(m)}, {_number(n)}::INTEGER, {_number(a)}::DOUBLE, {_number(b)}::DOUBLE, {_text(u)}, {x}::DOUBLE, {_text(p)}, {_text(e)}, {str(o).lower()})"
    for i, m, n, a, b, u, x, p, e, o in _GROUPS
)


@bind(
    f"""WITH gr(group_id, mode, n, lo, hi, unit, lim, ps, ex, open) AS (VALUES {_GROUPS_SQL}),
g AS (SELECT *, string_split(ps, ' ') AS paths FROM gr),
op AS (SELECT o_orderkey AS op_id, o_orderstatus AS mode, 1 + o_orderkey % 3 AS n, CASE WHEN o_custkey % 11 <> 0 THEN (o_custkey % 50 - 10)::DOUBLE END AS c,
  CASE o_orderkey % 4 WHEN 0 THEN ['ac', 'dc'] WHEN 1 THEN ['ac'] WHEN 2 THEN ['aux', 'none'] ELSE [] END AS required FROM orders),
d AS (SELECT l_orderkey AS op_id, l_linenumber::VARCHAR AS path_id, sum(l_quantity) AS value, CASE WHEN l_linenumber = 5 THEN 'VA' ELSE 'W' END AS unit FROM lineitem GROUP BY 1, 2, 4),
rq AS (SELECT op_id, mode, n, c, unnest(required) AS group_id FROM op),
w AS (SELECT op_id, group_id FROM rq UNION SELECT op_id, group_id FROM op JOIN g ON g.mode = op.mode),
j AS (SELECT w.op_id, w.group_id, g.unit, g.lim, g.paths, g.ex, g.open FROM w JOIN op ON op.op_id = w.op_id LEFT JOIN g ON g.group_id = w.group_id AND g.mode = op.mode AND (g.n IS NULL OR g.n = op.n)
  AND ((lo IS NULL AND hi IS NULL) OR (c IS NOT NULL AND coalesce(c >= lo, true) AND coalesce(c <= hi, true)))),
m AS (SELECT op_id, group_id, count(unit) AS k, any_value(unit) AS unit, any_value(lim) AS lim, any_value(paths) AS paths, any_value(ex) AS ex, coalesce(bool_or(open), false) AS open FROM j GROUP BY 1, 2),
s AS (SELECT m.op_id, m.group_id, m.unit, lim, ex, coalesce(sum(value), 0) AS total, coalesce(bool_or(d.unit <> m.unit), false) AS mixed, list(path_id) FILTER (value > 0) AS active
  FROM m LEFT JOIN d ON d.op_id = m.op_id AND list_contains(paths, path_id) WHERE k = 1 AND NOT open GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT *, unnest(string_split(ex, ' ')) AS pair FROM s WHERE NOT mixed AND ex <> '')
SELECT op_id, 'capacity_condition_unknown' AS "check", group_id AS subject, 'UNRESOLVED' AS status, NULL::DOUBLE AS demand FROM m WHERE k <> 1 OR open
UNION ALL SELECT op_id, 'capacity_unit_mismatch', group_id, 'UNRESOLVED', NULL FROM s WHERE mixed
UNION ALL SELECT op_id, 'combined_capacity', group_id, CASE WHEN total <= lim THEN 'ELIGIBLE' ELSE 'BLOCKED' END, round(total, 3) FROM s WHERE NOT mixed
UNION ALL SELECT op_id, 'simultaneous_exclusion', group_id || '/' || pair, CASE WHEN coalesce(list_contains(active, split_part(pair, '/', 1)) AND list_contains(active, split_part(pair, '/', 2)), false) THEN 'BLOCKED' ELSE 'ELIGIBLE' END, NULL FROM e
UNION ALL SELECT op_id, 'demand_capacity_coverage', path_id, 'UNRESOLVED', NULL FROM d WHERE NOT EXISTS (SELECT 1 FROM rq JOIN g ON g.group_id = rq.group_id AND g.mode = rq.mode WHERE rq.op_id = d.op_id AND list_contains(g.paths, d.path_id))"""
)
def shared_capacity_checks(t: Tables) -> DataFrame:
    """Orders as operations of the mode of their status, lines as demands on the paths 1 to 7."""
    k = F.col("o_orderkey")
    ids = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    operations = t.orders.select(
        k.alias("op_id"), F.col("o_orderstatus").alias("mode"), (1 + k % 3).alias("battery_count"),
        F.when(F.col("o_custkey") % 11 != 0, (F.col("o_custkey") % 50 - 10).cast("double")).alias("temperature_c"),
        F.when(k % 4 == 0, ids("ac", "dc")).when(k % 4 == 1, ids("ac")).when(k % 4 == 2, ids("aux", "none")).otherwise(ids()).alias("required"),
    )
    unit = F.when(F.col("l_linenumber") == 5, F.lit("VA")).otherwise(F.lit("W"))
    # lines of an order are summed where they will meet it
    demands = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("op_id"), F.col("l_linenumber").cast("string").alias("path_id"), unit.alias("unit")).agg(F.sum("l_quantity").alias("value"))
    rows = t.spark.createDataFrame(
        list(_GROUPS), "group_id string, mode string, battery_count int, least_c double, most_c double, unit string, limit double, ps string, ex string, open boolean"
    )
    pair = lambda x: F.struct(F.split_part(x, F.lit("/"), F.lit(1)).alias("a"), F.split_part(x, F.lit("/"), F.lit(2)).alias("b"))
    groups = rows.withColumns({"paths": F.split("ps", " "), "excluded": F.transform(F.array_remove(F.split("ex", " "), ""), pair)}).drop("ps", "ex")
    return pw.shared_capacity_checks(operations, demands, groups).withColumn("demand", F.round("demand", 3))


@bind(
    """WITH c AS (SELECT p_partkey, p_size, p_retailprice, string_split(p_name, ' ') AS need,
  CASE p_partkey % 3 WHEN 0 THEN ['Red', 'plate', 'small', 'Wid-get', 'hot', 'RING!'] WHEN 1 THEN [] END AS have FROM part),
v AS (SELECT *, list_filter(list_transform(need, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS n, list_filter(list_transform(coalesce(have, []), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS h FROM c),
k AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'unknown' WHEN 40 <= p_size * 2 THEN 'compatible' ELSE 'incompatible' END AS "current",
  CASE WHEN len(n) = 0 OR have IS NULL THEN NULL WHEN len(h) = 0 THEN 'unknown' WHEN len(list_filter(n, lambda x: NOT list_contains(h, x))) = 0 THEN 'compatible' ELSE 'incompatible' END AS accessory,
  CASE WHEN len(n) = 0 OR p_partkey % 5 <> 0 THEN NULL WHEN len(h) = 0 THEN 'unknown' WHEN len(list_filter(n, lambda x: NOT list_contains(h, x))) = 0 THEN 'compatible' ELSE 'incompatible' END AS converter,
  CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_size % 9 = 0 OR p_partkey % 7 = 0 THEN 'unknown' WHEN p_size + 5 <= 45 AND p_size <= 40 AND 2 * p_size <= 85 THEN 'compatible' ELSE 'incompatible' END AS fit,
  CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_size % 10 = 0 THEN 'unknown' WHEN p_retailprice / 50 <= 25 THEN 'compatible' ELSE 'incompatible' END AS weight FROM v)
SELECT *, CASE WHEN 'incompatible' IN ("current", coalesce(accessory, ''), coalesce(converter, ''), coalesce(fit, ''), coalesce(weight, '')) THEN 'incompatible'
  WHEN 'unknown' IN ("current", coalesce(accessory, ''), coalesce(converter, ''), coalesce(fit, ''), coalesce(weight, '')) THEN 'unknown' ELSE 'compatible' END AS status FROM k"""
)
def component_checks(t: Tables) -> DataFrame:
    """Current, accessory, converter, fit and weight; the words of a part's name stand for what it needs."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    none = F.lit(None).cast("double")
    have = F.when(k % 3 == 0, F.array(*map(F.lit, ("Red", "plate", "small", "Wid-get", "hot", "RING!")))).when(k % 3 == 1, F.array().cast("array<string>"))
    need = F.split("p_name", " ")
    space = [F.when(k % 4 != 0, F.lit(v)) for v in (45.0, 40.0, 85.0)]
    installed = [s + 5, F.when(F.col("p_size") % 9 != 0, s), s * 2]
    checks = {
        "current": sel.limit_check(F.lit(40.0), F.when(F.col("p_size") % 6 != 0, s * 2)),
        "accessory": sel.supplied_check(need, have),
        "converter": sel.supplied_check(need, have, k % 5 == 0),
        "fit": sel.fit_check(space, [F.when(k % 7 != 0, s), none, none], installed),
        "weight": sel.checked(k % 8 != 0, F.col("p_size") % 10 != 0, F.col("p_retailprice") / 50 <= 25),
    }
    return sel.compatibility(t.part, checks).select("p_partkey", *checks, "status")


@bind(
    """WITH w AS (SELECT c_custkey, o_orderkey, l_linenumber, o_orderstatus AS s, l_returnflag AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 > 0 LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber % 2 = 1),
r AS (SELECT c_custkey, o_orderkey, l_linenumber, greatest(CASE WHEN o_orderkey IS NULL THEN 2 WHEN s = 'F' THEN 3 ELSE 1 END, CASE WHEN l_linenumber IS NULL THEN 2 WHEN f = 'R' THEN 3 WHEN f = 'A' THEN 2 ELSE 1 END) AS g FROM w)
SELECT c_custkey, count(*) AS witnesses, count(*) FILTER (o_orderkey IS NULL OR l_linenumber IS NULL) AS placeholders, CASE min(g) WHEN 1 THEN 'ELIGIBLE' WHEN 2 THEN 'UNRESOLVED' ELSE 'BLOCKED' END AS status FROM r GROUP BY 1"""
)
def witness_enumeration(t: Tables) -> DataFrame:
    """Customers as bindings, two thirds of the orders as their ports, odd lines as paths of the ports."""
    ports = t.orders.where(F.col("o_orderkey") % 3 > 0).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    paths = t.lineitem.where(F.col("l_linenumber") % 2 == 1).select("l_orderkey", "l_linenumber", "l_returnflag")
    every = sel.enumerate_witnesses(t.customer.select("c_custkey"), ports, paths, ["c_custkey"], ["l_orderkey"])
    flag = F.col("l_returnflag")
    gated = every.select(
        "c_custkey", (~(F.col("has_port") & F.col("has_path"))).alias("placeholder"),
        F.when(~F.col("has_port"), F.lit("UNKNOWN")).when(F.col("o_orderstatus") == "F", F.lit("NO")).otherwise(F.lit("YES")).alias("port"),
        F.when(~F.col("has_path"), F.lit("UNKNOWN")).when(flag == "R", F.lit("NO")).when(flag == "A", F.lit("UNKNOWN")).otherwise(F.lit("YES")).alias("path"),
    )
    status = sel.witness_status(gated, ["c_custkey"], ["port", "path"])
    missing = gated.groupBy("c_custkey").agg(F.count_if("placeholder").alias("placeholders"))
    return status.join(missing, "c_custkey")


_RULE_ROWS = (
    ("r1", 2, "exact", "red plate", "power", "p.red"),
    ("r2", 2, "pattern", "^(small|large|red) .*plate$", None, "p.plate"),
    ("r3", 2, "pattern", "hot", "power", "p.hot"),
    ("r4", 2, "pattern", "rod$", "energy", "p.rod"),
    ("r1", 3, "exact", "RED plate", None, "q.red"),
    ("r5", 3, "pattern", "gear|widget", "power", "q.moving"),
    ("r6", 3, "pattern", "(^| )(old|blue) ", "power", "q.old"),
)
_RULES_SQL = ", ".join(f"({_text(a)}, {b}, {_text(c)}, {_text(d)}, {_text(e)}, {_text(f)})" for a, b, c, d, e, f in _RULE_ROWS)


@bind(
    f"""WITH r(rule_id, revision, kind, pattern, dim, projection) AS (VALUES {_RULES_SQL}),
f AS (SELECT p_partkey, lower(p_name) AS label, CASE WHEN p_size % 3 = 0 THEN 'energy' ELSE 'power' END AS dimension, 2 + p_partkey % 3 AS revision FROM part),
h AS (SELECT p_partkey, rule_id, projection, dim IS NULL OR dim = dimension AS fits FROM f JOIN r ON r.revision = f.revision AND CASE kind WHEN 'exact' THEN label = lower(pattern) ELSE regexp_matches(label, pattern) END),
c AS (SELECT p_partkey, count(*) FILTER (fits) AS n, min(rule_id) FILTER (fits) AS rule_id, min(projection) FILTER (fits) AS projection FROM h GROUP BY 1)
SELECT f.p_partkey, CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 0 THEN 'dimension_conflict' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS rule_code,
  CASE WHEN n = 1 THEN rule_id END AS rule_id, CASE WHEN n = 1 THEN projection END AS projection FROM f LEFT JOIN c USING (p_partkey)"""
)
def semantic_rules(t: Tables) -> DataFrame:
    """Part names as labels; revision 4 has no rules."""
    rules = t.spark.createDataFrame(list(_RULE_ROWS), "rule_id string, revision long, kind string, pattern string, dimension string, projection string")
    dimension = F.when(F.col("p_size") % 3 == 0, F.lit("energy")).otherwise(F.lit("power"))
    rows = t.part.select("p_partkey", F.col("p_name").alias("label"), dimension.alias("dimension"), (2 + F.col("p_partkey") % 3).alias("revision"))
    return facts.apply_rules(rows, rules).select("p_partkey", "rule_code", "rule_id", "projection")


@bind(
    """WITH b AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_quantity * 10 AS x0, l_quantity * 10 + 5 * l_linenumber AS x1, l_extendedprice % 1000 AS y0, l_extendedprice % 1000 + l_tax * 200 AS y1 FROM lineitem)
SELECT a.l_suppkey, a.id AS a, b.id AS b FROM b a JOIN b ON a.l_suppkey = b.l_suppkey AND a.id < b.id AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)
WHERE a.y0 < a.y1 AND b.y0 < b.y1"""
)
def box_overlaps(t: Tables) -> DataFrame:
    """Lines as boxes on the page of their supplier."""
    x, y = F.col("l_quantity") * 10, F.col("l_extendedprice") % 1000
    boxes = t.lineitem.select(
        "l_suppkey", (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("id"),
        x.alias("x0"), (x + 5 * F.col("l_linenumber")).alias("x1"), y.alias("y0"), (y + F.col("l_tax") * 200).alias("y1"),
    )
    return ranges.box_overlaps(boxes, ["l_suppkey"], "id", (40.0, 20.0))


_PARTS_SQL = "CASE WHEN source IS NULL THEN 'unscoped' WHEN n_chars % 5 = 0 THEN 'inconsistent' WHEN lang IS NULL OR lang = 'fr' THEN 'unlabelled' ELSE 'grouped' END"


@bind(
    f"""WITH d AS (SELECT doc_id, source, lang, {_PARTS_SQL} AS part FROM documents)
SELECT part, CASE WHEN part = 'grouped' THEN source || '/' || lang ELSE '' END AS grp, count(*) AS facts, 0 AS unaccounted FROM d GROUP BY 1, 2"""
)
def reconciliation_parts(t: Tables) -> DataFrame:
    """Documents as facts, put into groups or one of three other parts; the parts account for every fact once."""
    docs = t.documents.select("doc_id", "source", "lang", "n_chars")
    parts = facts.disjoint_parts(
        docs,
        [("unscoped", F.col("source").isNull()), ("inconsistent", F.col("n_chars") % 5 == 0), ("unlabelled", F.col("lang").isNull() | (F.col("lang") == "fr"))],
        "grouped",
    )
    off = facts.accounting(docs, parts, "doc_id").agg(F.count("*").cast("int").alias("unaccounted"))
    grp = F.when(F.col("part") == "grouped", F.concat_ws("/", "source", "lang")).otherwise(F.lit(""))
    counts = parts.groupBy("part", grp.alias("grp")).agg(F.count("*").alias("facts"))
    # one row
    return counts.crossJoin(F.broadcast(off))


@bind(
    """WITH e AS (SELECT DISTINCT user_id, event_type, dayofweek(ts) + 1 AS day FROM events), n AS (SELECT user_id, count(DISTINCT event_type) AS n FROM e GROUP BY 1)
SELECT e.user_id, day::INTEGER AS day FROM e JOIN n ON n.user_id = e.user_id GROUP BY e.user_id, day, n HAVING count(*) = n"""
)
def common_targets(t: Tables) -> DataFrame:
    """The week days on which a user had every kind of event that the user has at all."""
    rows = t.events.select("user_id", "event_type", F.dayofweek("ts").alias("day"))
    return links.common_targets(rows, ["user_id"], "event_type", "day")


_SCRIPTS = (
    '<script id="data" type="application/json">{"k": %d}</script>',
    "<SCRIPT type='application/json; charset=utf-8' id=data>[%d, 2]</SCRIPT>",
    '<script id="data" type="application/json">{"k": %d}</script><script type="application/json" id="data">{}</script>',
    '<script id="data" type="application/json">{k: %d</script>',
    '<!-- <script id="data" type="application/json">{"k": %d}</script> --><script id="other" type="application/json">1</script>',
    '<script id="data" type="text/plain">{"k": %d}</script><script type="application/ld+json">{"@id": "x"}</script>',
)
_SCRIPTS_SQL = ", ".join("'" + x.replace("'", "''") + "'" for x in _SCRIPTS)


@bind(
    rf"""WITH p AS (SELECT page_id, html || replace(list_extract([{_SCRIPTS_SQL}], (page_id % {len(_SCRIPTS)} + 1)::INTEGER), '%d', page_id::VARCHAR) AS html FROM pages),
s AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?is)<script\b[^>]*>.*?</script\s*>')) AS x FROM p),
h AS (SELECT page_id, regexp_extract(x, '(?is)^<script\b[^>]*>(.*)</script\s*>$', 1) AS json FROM s
  WHERE regexp_matches(x, '(?is)^<script\b[^>]*\sid=[''"]?data[''"\s>]') AND regexp_matches(x, '(?is)^<script\b[^>]*\stype=[''"]application/json\s*[;''"]')),
c AS (SELECT page_id, count(*) AS n, min(json) AS json FROM h GROUP BY 1)
SELECT p.page_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN json_valid(json) THEN 'found' ELSE 'invalid' END AS json_status, CASE WHEN n = 1 AND json_valid(json) THEN json END AS json
FROM p LEFT JOIN c ON c.page_id = p.page_id"""
)
def embedded_json(t: Tables) -> DataFrame:
    """Pages with one of six endings, among them repeated, broken, commented-out and mistyped scripts."""
    script = F.get(F.array(*map(F.lit, _SCRIPTS)), (F.col("page_id") % len(_SCRIPTS)).cast("int"))
    page = F.concat("html", F.replace(script, F.lit("%d"), F.col("page_id").cast("string")))
    return html.embedded_json(t.pages.select("page_id", page.alias("html")), "data").select("page_id", "json_status", "json")


@bind(
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS ordinal FROM conversations"""
)
def tag_ordinals(t: Tables) -> DataFrame:
    rows = sequences.ordinals(t.conversations, ["conv_id"], "role", ["turn", "text"], "ordinal")
    return rows.select("conv_id", "turn", "role", F.col("ordinal").cast("long").alias("ordinal"))


@bind(
    """SELECT l_partkey, (min((l_shipdate, l_orderkey, l_linenumber)))[1] AS l_shipdate, (min((l_shipdate, l_orderkey, l_linenumber)))[2] AS l_orderkey, (min((l_shipdate, l_orderkey, l_linenumber)))[3] AS l_linenumber
FROM lineitem GROUP BY 1"""
)
def first_by_tuple(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return sequences.first_of(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_suppkey")


_BANKS_SQL = """
u AS (SELECT p_partkey, CASE WHEN p_size % 13 <> 0 THEN 6.0::DOUBLE * (1 + p_partkey % 2) END AS uv, p_size::DOUBLE AS ah, CASE WHEN p_size % 11 <> 0 THEN p_size * 2.0::DOUBLE END AS ua, CASE WHEN p_size % 7 <> 0 THEN p_size * 5.0::DOUBLE END AS pk,
  CASE WHEN p_size % 5 <> 0 THEN (p_size % 10)::DOUBLE END AS ps, 1 + p_size % 4 AS ms, 1 + p_size % 3 AS mp, 24.0::DOUBLE AS nv, p_retailprice AS nwh, CASE WHEN p_partkey % 9 <> 0 THEN 60.0::DOUBLE END AS na,
  CASE WHEN p_partkey % 4 <> 0 THEN 150.0::DOUBLE END AS sa, CASE WHEN p_partkey % 6 <> 0 THEN 5.0::DOUBLE END AS ss FROM part)
"""
_BANK_CODES_SQL = """
CASE WHEN s > ms OR p > mp THEN 'topology_not_permitted' WHEN s * uv = nv THEN 'voltage_requirement_pass'
    WHEN uv IS NOT NULL AND nv / uv > s AND nv / uv <= ms AND nv / uv = round(nv / uv) THEN 'voltage_requirement_insufficient' WHEN ms <= s THEN 'series_not_permitted' ELSE 'max_series_insufficient' END AS voltage_code,
  CASE WHEN s > ms OR p > mp THEN 'topology_not_permitted' WHEN s * uv * p * ah >= nwh THEN 'energy_requirement_pass' WHEN ms * mp * uv * ah >= nwh THEN 'energy_requirement_insufficient' ELSE 'max_bank_energy_insufficient' END AS energy_code,
  CASE WHEN na IS NULL THEN 'continuous_discharge_unknown' WHEN s > ms OR p > mp THEN 'topology_not_permitted' WHEN ua IS NULL THEN 'continuous_discharge_unknown' WHEN p * ua >= na THEN 'continuous_discharge_pass'
    WHEN mp * ua >= na THEN 'continuous_discharge_insufficient' WHEN mp <= p THEN 'parallel_not_permitted' ELSE 'max_parallel_insufficient' END AS discharge_code,
  CASE WHEN sa IS NULL AND ss IS NULL THEN 'surge_not_requested' WHEN sa IS NULL OR ss IS NULL THEN 'surge_incomplete' WHEN s > ms OR p > mp THEN 'topology_not_permitted' WHEN pk IS NULL THEN 'surge_unknown' WHEN sa > p * pk THEN 'surge_insufficient'
    WHEN ps IS NULL THEN 'surge_duration_missing' WHEN ss > ps THEN 'surge_duration_insufficient' ELSE 'surge_pass' END AS surge_code
"""


def _units(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    given = lambda when, x: F.when(when, x.cast("double"))
    return t.part.select(
        k, given(s % 13 != 0, 6 * (1 + k % 2)).alias("unit_v"), s.cast("double").alias("unit_ah"), given(s % 11 != 0, s * 2).alias("unit_a"),
        given(s % 7 != 0, s * 5).alias("peak_a"), given(s % 5 != 0, s % 10).alias("peak_s"), (1 + s % 4).alias("max_series"), (1 + s % 3).alias("max_parallel"),
        F.lit(24.0).alias("need_v"), F.col("p_retailprice").alias("need_wh"), given(k % 9 != 0, F.lit(60)).alias("need_a"),
        given(k % 4 != 0, F.lit(150)).alias("surge_a"), given(k % 6 != 0, F.lit(5)).alias("surge_s"),
    )


@bind(
    f"""WITH {_BANKS_SQL}, b AS (SELECT *, 1 + p_partkey % 5 AS s, 1 + p_partkey % 3 AS p FROM u), c AS (SELECT p_partkey, {_BANK_CODES_SQL} FROM b)
SELECT *, CASE WHEN NOT (voltage_code IN ('voltage_requirement_pass', 'topology_not_permitted') AND energy_code IN ('energy_requirement_pass', 'topology_not_permitted')
    AND discharge_code IN ('continuous_discharge_pass', 'topology_not_permitted', 'continuous_discharge_unknown')
    AND surge_code IN ('surge_pass', 'surge_not_requested', 'topology_not_permitted', 'surge_incomplete', 'surge_unknown', 'surge_duration_missing')) THEN 'FAIL'
  WHEN voltage_code = 'topology_not_permitted' OR discharge_code IN ('topology_not_permitted', 'continuous_discharge_unknown') OR surge_code IN ('topology_not_permitted', 'surge_incomplete', 'surge_unknown', 'surge_duration_missing') THEN 'CONDITIONAL' ELSE 'PASS' END AS severity FROM c"""
)
def bank_checks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    banks = _units(t).withColumns({"series": 1 + k % 5, "parallel": 1 + k % 3})
    return battery.bank_checks(banks).select("p_partkey", "voltage_code", "energy_code", "discharge_code", "surge_code", "severity")


@bind(
    f"""WITH {_BANKS_SQL}, b AS (SELECT * FROM u, range(1, 5) x(s), range(1, 4) y(p) WHERE s <= ms AND p <= mp), c AS (SELECT p_partkey, s, p, {_BANK_CODES_SQL} FROM b)
SELECT p_partkey, s::INTEGER AS series, p::INTEGER AS parallel FROM c WHERE voltage_code = 'voltage_requirement_pass' AND energy_code = 'energy_requirement_pass' AND discharge_code = 'continuous_discharge_pass' AND surge_code IN ('surge_pass', 'surge_not_requested')"""
)
def feasible_banks(t: Tables) -> DataFrame:
    return battery.feasible_banks(_units(t)).select("p_partkey", F.col("series").cast("int"), F.col("parallel").cast("int"))


@bind(
    """WITH f AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '  Rated  POWER' WHEN 1 THEN 'Voltage range' WHEN 2 THEN 'finish' ELSE 'note' END AS label,
  CASE p_size % 5 WHEN 0 THEN p_size || ' W' WHEN 1 THEN p_size || ' - ' || (p_size + 4) || ' V' ELSE '  Some   ' || p_type END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'inverter' WHEN p_partkey % 3 = 1 THEN 'battery' END AS role, 'eu' AS region FROM part),
m AS (SELECT *, CASE label WHEN '  Rated  POWER' THEN CASE role WHEN 'inverter' THEN 'output_w' WHEN 'battery' THEN 'ambiguous' ELSE 'power_w' END WHEN 'Voltage range' THEN 'range_v' WHEN 'finish' THEN 'finish' END AS field FROM f),
k AS (SELECT *, CASE WHEN field IN ('output_w', 'power_w') THEN 'measurement' WHEN field = 'range_v' THEN 'range' WHEN field = 'finish' THEN 'text' END AS kind FROM m),
n AS (SELECT *, CASE kind WHEN 'measurement' THEN regexp_extract(value, '^([0-9]+) W$', 1) WHEN 'range' THEN regexp_extract(value, '^([0-9]+) - [0-9]+ V$', 1) WHEN 'text' THEN lower(trim(regexp_replace(value, ' +', ' ', 'g'))) END AS norm FROM k)
SELECT p_partkey, CASE WHEN field IS NULL THEN 'unmapped' WHEN field = 'ambiguous' THEN 'ambiguous' WHEN norm = '' THEN 'invalid_value' ELSE 'mapped' END AS field_code, CASE WHEN field <> 'ambiguous' THEN field END AS canonical_field,
  CASE WHEN norm <> '' AND kind = 'text' THEN norm WHEN norm <> '' THEN norm || '.0' END AS normalised FROM n"""
)
def field_mapping(t: Tables) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    rows = t.part.select(
        k,
        F.when(s % 4 == 0, F.lit("  Rated  POWER")).when(s % 4 == 1, F.lit("Voltage range")).when(s % 4 == 2, F.lit("finish")).otherwise(F.lit("note")).alias("label"),
        F.when(s % 5 == 0, F.concat(text(s), F.lit(" W"))).when(s % 5 == 1, F.concat(text(s), F.lit(" - "), text(s + 4), F.lit(" V"))).otherwise(F.concat(F.lit("  Some   "), F.col("p_type"))).alias("value"),
        F.when(k % 3 == 0, F.lit("inverter")).when(k % 3 == 1, F.lit("battery")).alias("role"),
        F.lit("eu").alias("region"),
    )
    mappings = t.spark.createDataFrame(
        [
            ("rated power", None, None, "power_w", "measurement"), ("Rated Power", "inverter", "eu", "output_w", "measurement"),
            ("rated power", "battery", "eu", "charge_w", "measurement"), ("rated  power", "battery", "eu", "discharge_w", "measurement"),
            ("voltage range", None, None, "range_v", "range"), ("Finish", None, None, "finish", "text"),
        ],
        "alias string, role string, region string, canonical_field string, value_kind string",
    )
    watts = lambda v: F.when(tx.parsed_quantity(v)["unit"] == "w", tx.parsed_quantity(v)["number"])
    kinds = {"measurement": watts, "range": lambda v: tx.voltage_range(v)["low_v"], "text": tx.collapsed}
    return facts.map_fields(rows, mappings, kinds).select("p_partkey", "field_code", "canonical_field", "normalised")


@bind(
    """WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id, octet_length(encode(html)) AS size, page_id % 4 = 0 AS official, page_id % 3 AS tier FROM pages),
p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN official THEN 0 ELSE 1 END, tier, page_id) AS place FROM r)
SELECT host, page_id, place FROM p WHERE place <= 50"""
)
def capture_order(t: Tables) -> DataFrame:
    """What is found of each host, official pages first; ``test_systems`` holds what is taken of it against a plain loop."""
    rows = t.pages.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), "page_id", F.octet_length("html").alias("size"), (F.col("page_id") % 4 == 0).alias("official"), (F.col("page_id") % 3).alias("tier")
    )
    out = facts.budgeted_captures(rows, ["host"], F.col("official"), ["tier", "page_id"], F.col("size"), 50, 20, 40_000)
    return out.select("host", "page_id", F.col("place").cast("long").alias("place"))


@bind(
    """WITH RECURSIVE p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id, octet_length(encode(html)) AS size,
  row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END, page_id % 3, page_id) AS place FROM pages),
f AS (SELECT * FROM p WHERE place <= 50),
w AS (SELECT host, page_id, place, size <= 40000 AS taken, CASE WHEN size <= 40000 THEN 1 ELSE 0 END AS n, CASE WHEN size <= 40000 THEN size ELSE 0 END AS used FROM f WHERE place = 1
  UNION ALL SELECT f.host, f.page_id, f.place, n < 20 AND used + size <= 40000, n + CASE WHEN n < 20 AND used + size <= 40000 THEN 1 ELSE 0 END, used + CASE WHEN n < 20 AND used + size <= 40000 THEN size ELSE 0 END
  FROM w JOIN f ON f.host = w.host AND f.place = w.place + 1)
SELECT host, page_id, place, taken FROM w"""
)
def captures_taken(t: Tables) -> DataFrame:
    """What is taken of what is found of each host: in order, while it fits the number and the bytes."""
    rows = t.pages.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), "page_id", F.octet_length("html").alias("size"), (F.col("page_id") % 4 == 0).alias("official"), (F.col("page_id") % 3).alias("tier")
    )
    out = facts.budgeted_captures(rows, ["host"], F.col("official"), ["tier", "page_id"], F.col("size"), 50, 20, 40_000)
    return out.select("host", "page_id", F.col("place").cast("long").alias("place"), "taken")


@bind(
    """SELECT 'orders' AS collection, o_orderkey::VARCHAR AS record, 'price' AS code, 'o_totalprice' AS path FROM orders WHERE NOT coalesce(o_totalprice > 20000, false)
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'status', 'o_orderstatus' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'parts', p_partkey::VARCHAR, 'name', 'p_name' FROM part WHERE NOT regexp_matches(p_name, 'a')
UNION ALL SELECT 'parts', p_partkey::VARCHAR, 'size', 'p_size' FROM part WHERE p_size > 40"""
)
def tree_issues(t: Tables) -> DataFrame:
    orders = [(F.col("o_totalprice") > 20000, "price", "o_totalprice"), (F.col("o_orderstatus").isin("F", "O"), "status", "o_orderstatus")]
    parts = [(F.col("p_name").contains("a"), "name", "p_name"), (F.col("p_size") <= 40, "size", "p_size")]
    return tables.tree_issues([("orders", t.orders, F.col("o_orderkey"), orders), ("parts", t.part, F.col("p_partkey"), parts)])


@bind(
    """WITH p AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders),
a AS (SELECT c_custkey, x.o_orderkey AS i, y.o_orderkey AS o FROM customer LEFT JOIN orders x ON x.o_custkey = c_custkey LEFT JOIN orders y ON y.o_custkey = c_custkey),
w AS (SELECT a.*, after AS path FROM a LEFT JOIN p ON p.o_custkey = c_custkey AND p.o_orderkey = i AND p.after = o)
SELECT c_custkey, count(*) AS witnesses, count(*) FILTER (path IS NULL) AS without_path, count(*) FILTER (i IS NULL) AS without_port FROM w GROUP BY 1"""
)
def product_witnesses(t: Tables) -> DataFrame:
    """Customers as candidates, their orders as ports, a path from each order to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ports = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("port"))
    paths = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(w).alias("target"))
    paths = paths.where(F.col("target").isNotNull()).withColumn("path", F.col("target"))
    every = sel.product_witnesses(t.customer, "c_custkey", ["in", "out"], [("main", "in", "out")], ports, paths, 4096)
    return every.groupBy("c_custkey").agg(
        F.count("*").alias("witnesses"), F.count_if(F.col("via_main").isNull()).alias("without_path"), F.count_if(F.col("at_in").isNull()).alias("without_port")
    )


@bind(
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_quantity <= 30 THEN 'YES' ELSE 'NO' END WHEN 1 THEN CASE WHEN l_tax > 0.07 THEN 'UNKNOWN' WHEN l_returnflag = 'R' THEN 'NO' ELSE 'YES' END
  WHEN 2 THEN CASE WHEN l_extendedprice BETWEEN 1000 AND 40000 THEN 'YES' ELSE 'NO' END ELSE 'UNKNOWN' END AS gate FROM lineitem"""
)
def constraint_gates(t: Tables) -> DataFrame:
    kinds = F.get(F.array(*map(F.lit, ("at_most", "capability", "range", "interface"))), (F.col("l_linenumber") % 4).cast("int"))
    price = F.col("l_extendedprice")
    evaluators = {
        "at_most": F.col("l_quantity") <= 30,
        "capability": F.when(~(F.col("l_tax") > 0.07), F.col("l_returnflag") != "R"),
        "range": sel.within(price, F.lit(1000), F.lit(40000)),
    }
    return t.lineitem.select("l_orderkey", "l_linenumber", sel.constraint_gate(kinds, evaluators).alias("gate"))


@bind(
    """SELECT doc_id, source IS NOT NULL AND CASE WHEN lang = 'fr' THEN true WHEN n_chars % 3 = 0 THEN true ELSE coalesce(lang = 'en', false) END AS applicable,
  source IS NOT NULL AND CASE WHEN lang = 'fr' THEN false WHEN n_chars % 3 = 0 THEN true ELSE coalesce(lang = 'en', false) END AS strictly FROM documents"""
)
def source_applicability(t: Tables) -> DataFrame:
    """French documents say nothing about their applicability."""
    says = F.when(F.col("lang") == "fr", F.lit(None).cast("string")).when(F.col("n_chars") % 3 == 0, F.lit("explicitly_reviewed"))
    says = says.when(F.col("lang") == "en", F.lit("direct_identity")).otherwise(F.lit("unrelated"))
    there = F.col("source").isNotNull()
    return t.documents.select("doc_id", sel.source_applicable(there, says, legacy=True).alias("applicable"), sel.source_applicable(there, says).alias("strictly"))


@bind(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN replace(p_name, ' ', '__') || 's' WHEN 2 THEN upper(replace(p_name, ' ', '%20')) || '-x' ELSE p_type END AS txt,
  CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[2] WHEN 2 THEN ' - ' END AS want FROM part),
n AS (SELECT p_partkey, trim(regexp_replace(lower(url_decode(txt)), '[-_\s]+', ' ', 'g')) AS txt, trim(regexp_replace(lower(want), '[-_\s]+', ' ', 'g')) AS want FROM t)
SELECT p_partkey, coalesce(want <> '' AND regexp_matches(' ' || txt || ' ', '[^\p{L}\p{N}]' || regexp_escape(want) || '[^\p{L}\p{N}]'), false) AS named FROM n"""
)
def identity_named(t: Tables) -> DataFrame:
    k, kind = F.col("p_partkey") % 4, F.col("p_name")
    said = F.when(k == 0, F.concat(F.lit("the "), kind)).when(k == 1, F.concat(F.replace(kind, F.lit(" "), F.lit("__")), F.lit("s")))
    said = said.when(k == 2, F.concat(F.upper(F.replace(kind, F.lit(" "), F.lit("%20"))), F.lit("-x"))).otherwise(F.col("p_type"))
    want = F.when(F.col("p_size") % 3 == 0, kind).when(F.col("p_size") % 3 == 1, F.get(F.split(kind, " "), F.lit(1))).otherwise(F.lit(" - "))
    return t.part.select("p_partkey", tx.contains_identity(said, want).alias("named"))


@bind(
    """WITH g AS (SELECT p_partkey, p_size, list_filter([CASE WHEN p_size % 2 = 0 THEN 'voltage' END, CASE WHEN p_size % 3 = 0 THEN 'current' END, CASE WHEN p_retailprice > 1000 THEN 'power' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'fit' END, CASE WHEN p_name LIKE '%plate' THEN 'accessory' END], lambda x: x IS NOT NULL) AS held FROM part)
SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'fit,weight' ELSE array_to_string(held, ',') END AS checks FROM g"""
)
def required_checks(t: Tables) -> DataFrame:
    s = F.col("p_size")
    asked = F.when(s % 10 == 0, F.array(F.lit("fit"), F.lit("weight"))).when(s % 10 == 1, F.array().cast("array<string>"))
    given = {
        "voltage": s % 2 == 0, "current": s % 3 == 0, "power": F.col("p_retailprice") > 1000, "fit": F.col("p_partkey") % 5 == 0, "accessory": F.col("p_name").endswith("plate"),
    }
    return t.part.select("p_partkey", F.concat_ws(",", sel.inferred_checks(asked, given)).alias("checks"))


@bind(
    """SELECT p_partkey, len(list_filter(string_split(lower(p_name), ' '), lambda x: NOT list_contains(['hot', 'plate', 'ring', 'red'], x))) = 0 AS supplied,
  array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: NOT list_contains(['hot', 'plate', 'ring', 'red'], x)), ',') AS missing FROM part"""
)
def required_sets(t: Tables) -> DataFrame:
    offered = F.array(*map(F.lit, ("HOT", " plate", "Ring", "red")))
    needed = F.split("p_name", " ")
    missing = F.array_except(F.transform(needed, lambda x: F.lower(F.trim(x))), F.transform(offered, lambda x: F.lower(F.trim(x))))
    return t.part.select("p_partkey", sel.contains_all(needed, offered).alias("supplied"), F.concat_ws(",", missing).alias("missing"))


@bind(
    """SELECT l_orderkey, l_linenumber, '{"flag":"' || l_returnflag || '","line":"' || l_linenumber || '","status":' || CASE WHEN l_tax > 0.05 THEN 'null' ELSE '"' || l_linestatus || '"' END || '}' AS canonical FROM lineitem"""
)
def canonical_objects(t: Tables) -> DataFrame:
    status = F.when(~(F.col("l_tax") > 0.05), F.col("l_linestatus"))
    line = F.col("l_linenumber").cast("string")
    one = F.create_map(F.lit("status"), status, F.lit("line"), line, F.lit("flag"), F.col("l_returnflag"))
    other = F.create_map(F.lit("line"), line, F.lit("flag"), F.col("l_returnflag"), F.lit("status"), status)
    # one object, its members in either order
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.canonical_object(F.when(F.col("l_partkey") % 2 == 0, one).otherwise(other)).alias("canonical"))
