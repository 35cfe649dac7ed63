"""Tables, lines and grids of pages, and nested JSON, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import layout
from ._registry import Tables, bind

_BOX = """b AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_quantity * 10 AS x0, l_quantity * 10 + 5 * l_linenumber AS x1,
  l_extendedprice % 1000 AS y0, l_extendedprice % 1000 + l_tax * 100 AS y1 FROM lineitem)"""


def _boxes(t: Tables) -> DataFrame:
    """Lines of orders as boxes on the page of their supplier."""
    x, y = F.col("l_quantity") * 10, F.col("l_extendedprice") % 1000
    return t.lineitem.select(
        "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        x.alias("x0"), (x + 5 * F.col("l_linenumber")).alias("x1"), y.alias("y0"), (y + F.col("l_tax") * 100).alias("y1"),
    )


@bind(
    f"""WITH RECURSIVE l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM lineitem),
c AS (SELECT l_orderkey, r, j, l_partkey, 1 + (l_suppkey + j) % 3 AS high, 1 + (l_partkey + 2 * j) % 2 + (CASE WHEN l_partkey % 31 = 0 THEN 3 ELSE 0 END) AS wide,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY r, j) AS k, max(r) OVER (PARTITION BY l_orderkey) AS last_row
  FROM (SELECT *, unnest(range(1 + l_partkey % 4)) AS j FROM l)),
w AS (
  SELECT l_orderkey, 0::BIGINT AS k, -1::BIGINT AS r, 0::BIGINT AS cursor, list_transform(range(60), lambda i: 0::BIGINT) AS taken, 0::BIGINT AS col, false AS over FROM c WHERE k = 1
  UNION ALL
  SELECT l_orderkey, k, r, col + wide, list_transform(range(60), lambda i: CASE WHEN i >= col AND i < col + wide THEN greatest(taken[i + 1], r + high) ELSE taken[i + 1] END),
    col, list_max(taken[col + 1 : col + wide]) > r
  FROM (SELECT c.l_orderkey, c.k, c.r, c.wide, c.high, w.taken,
      list_min(list_filter(range(CASE WHEN c.r = w.r THEN w.cursor ELSE 0 END, 60), lambda i: w.taken[i + 1] <= c.r)) AS col
    FROM w JOIN c ON c.l_orderkey = w.l_orderkey AND c.k = w.k + 1)
)
SELECT c.l_orderkey, c.r AS row, row_number() OVER (PARTITION BY c.l_orderkey, c.r ORDER BY j) - 1 AS cell, w.col::INTEGER AS first_column, (w.col + wide)::INTEGER AS end_column,
  least(c.r + high, last_row + 1)::BIGINT AS end_row, over AS overlaps, j = 0 AS header, CASE WHEN j = 0 THEN 'row' END AS scope, 'p' || l_partkey || '<' || j || ' x' AS text,
  CASE WHEN j = 1 THEN 'text:p' || l_partkey || '<' || j || '|superscript:x' END AS runs
FROM w JOIN c ON c.l_orderkey = w.l_orderkey AND c.k = w.k"""
)
def table_cells(t: Tables) -> DataFrame:
    """Every page, and every order as a page with a table: a row per line, 1 to 4 cells in it, their spans from part and supplier."""
    j = F.sequence(F.lit(0), (F.col("l_partkey") % 4).cast("int"))
    wide = lambda j: 1 + (F.col("l_partkey") + 2 * j) % 2 + F.when(F.col("l_partkey") % 31 == 0, 3).otherwise(0)
    start = lambda j: F.when(j == 0, F.lit("<th scope=ROW")).otherwise(F.lit("<TD class='a'"))
    said = lambda j: F.concat(F.lit("<b>p"), F.col("l_partkey"), F.lit("</b>&lt;"), j, F.when(j == 1, F.lit(" <sup>x</sup>")).otherwise(F.lit("\n x")))
    cell = lambda j: F.concat(
        start(j), F.lit(' rowspan="'), 1 + (F.col("l_suppkey") + j) % 3, F.lit("\" colspan='"), wide(j), F.lit("'>"), said(j), F.when(j == 2, F.lit("</td>")).otherwise(F.lit(""))
    )
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(j, cell), ""), F.lit("</tr>"))
    lines = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("html")).alias("line"))
    joined = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("line"))["html"], "\n").alias("rows"))
    html = F.concat(F.lit("<p>before</p><!-- <table> --><table border=1>"), F.col("rows"), F.lit("</table><p>after"))
    pages = joined.select("l_orderkey", html.alias("html")).unionByName(t.pages.select((-F.col("page_id") - 1).alias("l_orderkey"), "html"))
    cells = layout.table_cells(pages, "l_orderkey")
    # counted before they are placed, where the cells of a page are in one task already
    rank = F.row_number().over(Window.partitionBy("l_orderkey", "table", "row").orderBy("seq"))
    placed = layout.placed_cells(cells.withColumn("cell", rank - 1), ["l_orderkey", "table"], "row", "seq", "row_span", "column_span")
    runs = F.array_join(F.transform("runs", lambda r: F.concat(r["kind"], F.lit(":"), r["text"])), "|")
    return placed.select(
        "l_orderkey", F.col("row").cast("long").alias("row"), F.col("cell").cast("long").alias("cell"), "first_column", "end_column", "end_row", "overlaps",
        "header", "scope", "text", runs.alias("runs"),
    )


@bind(
    f"""WITH {_BOX}, s AS (SELECT *, max(y1) OVER (PARTITION BY l_suppkey ORDER BY y0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE y0 < y1),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY y0, id ROWS UNBOUNDED PRECEDING) - 1 AS line FROM s)
SELECT l_suppkey, line::BIGINT AS line, count(*) AS glyphs, min(y0) AS bottom, max(y1) AS top FROM n GROUP BY 1, 2"""
)
def text_lines(t: Tables) -> DataFrame:
    lines = layout.text_lines(_boxes(t), ["l_suppkey"], "id", "y0", "y1")
    return lines.groupBy("l_suppkey", "line").agg(F.count("*").alias("glyphs"), F.min("y0").alias("bottom"), F.max("y1").alias("top"))


@bind(
    f"""WITH {_BOX.replace("b AS", "a AS")}, b AS (SELECT l_suppkey, id, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM a GROUP BY 1, 2), r AS (SELECT DISTINCT l_suppkey, l_partkey % 40 * 100 + l_linenumber AS rule, l_partkey % 40 % 2 = 0 AS lying, (l_partkey % 40 % 5) * 100.0 AS low, (l_partkey % 40 % 5 + l_linenumber) * 100.0 AS high,
    (l_partkey % 40) * 25.0 AS at, 0.5 AS ink FROM lineitem),
h AS (SELECT b.*, t.rule AS top_rule, t.at AS top, t.low - t.ink AS tl, t.high + t.ink AS th FROM b JOIN r t ON t.l_suppkey = b.l_suppkey AND lying AND t.at - t.ink >= y1 AND t.low - t.ink <= x0 AND t.high + t.ink >= x1
  QUALIFY row_number() OVER (PARTITION BY b.l_suppkey, b.id ORDER BY t.at, t.rule) = 1),
k AS (SELECT h.*, t.at AS bottom, t.low - t.ink AS bl, t.high + t.ink AS bh FROM h JOIN r t ON t.l_suppkey = h.l_suppkey AND lying AND t.at + t.ink <= y0 AND t.low - t.ink <= x0 AND t.high + t.ink >= x1
  QUALIFY row_number() OVER (PARTITION BY h.l_suppkey, h.id ORDER BY t.at DESC, t.rule) = 1),
f AS (SELECT k.*, t.at AS lft FROM k JOIN r t ON t.l_suppkey = k.l_suppkey AND NOT lying AND t.at + t.ink <= x0 AND t.low - t.ink <= bottom AND t.high + t.ink >= top
  QUALIFY row_number() OVER (PARTITION BY k.l_suppkey, k.id ORDER BY t.at DESC, t.rule) = 1),
g AS (SELECT f.*, t.at AS rgt FROM f JOIN r t ON t.l_suppkey = f.l_suppkey AND NOT lying AND t.at - t.ink >= x1 AND t.low - t.ink <= bottom AND t.high + t.ink >= top
  QUALIFY row_number() OVER (PARTITION BY f.l_suppkey, f.id ORDER BY t.at, t.rule) = 1),
c AS (SELECT DISTINCT l_suppkey, lft, rgt, bottom, top FROM g WHERE tl <= lft AND th >= rgt AND bl <= lft AND bh >= rgt),
m AS (SELECT c.*, b.id, b.x0 >= lft AND b.x1 <= rgt AND b.y0 > bottom AND b.y1 < top AS within, b.y0 > bottom AND b.y0 < top AND b.x0 < rgt AND b.x1 > lft AS crosses FROM c JOIN b USING (l_suppkey)),
n AS (SELECT l_suppkey, id FROM m WHERE within GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_suppkey, lft AS "left", rgt AS "right", bottom, top, count(*) FILTER (within) AS n_items, string_agg(CASE WHEN within THEN id END, ',' ORDER BY id) AS items
FROM m LEFT JOIN n USING (l_suppkey, id) GROUP BY 1, 2, 3, 4, 5
HAVING count(*) FILTER (within) > 0 AND count(*) FILTER (crosses AND NOT within) = 0 AND count(*) FILTER (within AND n.id IS NOT NULL) = 0"""
)
def grid_cells(t: Tables) -> DataFrame:
    """Parts as ruling lines on the pages of the suppliers that sell them: even ones lie, odd ones stand."""
    k = F.col("l_partkey") % 40
    low, high, at = (k % 5) * 100.0, (k % 5 + F.col("l_linenumber")) * 100.0, k * 25.0
    lying = k % 2 == 0
    side = lambda own, other: F.when(lying, own).otherwise(other)
    rules = t.lineitem.select(
        "l_suppkey", (k * 100 + F.col("l_linenumber")).alias("rule"), side(low, at).alias("x0"), side(high, at).alias("x1"),
        side(at, low).alias("y0"), side(at, high).alias("y1"), F.lit(0.5).alias("ink"),
    ).distinct()
    # lines of one order and number are one box
    sides = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    boxes = _boxes(t).groupBy("l_suppkey", "id").agg(*sides)
    return layout.grid_cells(boxes, rules, ["l_suppkey"], 100.0).withColumn("items", F.array_join("items", ","))


@bind(
    """WITH e AS (SELECT event_id, user_id, event_type, json_extract(props, '$.k')::BIGINT AS k, regexp_replace(value::VARCHAR, '\\.0$', '') AS v FROM events),
c AS (SELECT event_id, CASE WHEN event_id % 50 <> 9 THEN '{"a":{"x":' || user_id || ',"y":' || (k * 10) || '},"props":{"k":' || k || '},"z":[{"a":"' || event_type || ' 1.0","b":' || v || '},[],{},null,'
  || (k * 100 + 50) || ']}' END AS canonical FROM e)
SELECT event_id, canonical, sha256(canonical) AS digest FROM c"""
)
def nested_canonical(t: Tables) -> DataFrame:
    """Events as nested objects, their keys in one of two orders and numbers in several spellings; some have a key twice."""
    k = F.get_json_object("props", "$.k").cast("long")
    inner = F.concat(F.lit('[ {"b" : '), F.col("value"), F.lit(', "a":"'), F.col("event_type"), F.lit(' 1.0"} , [],{}, null, '), k, F.lit(".50E+2]"))
    numbers = F.concat(F.lit('{"y":'), k, F.lit('e1,"x":'), F.col("user_id"), F.lit(".00}"))
    one = F.concat(F.lit('{"z":'), inner, F.lit(',"props":'), "props", F.lit(',"a":'), numbers, F.lit("}"))
    other = F.concat(F.lit('{"a":'), numbers, F.lit(',\n"z":'), inner, F.lit(',"props":'), "props", F.lit("}"))
    twice = F.concat(F.lit('{"a":1,"a":'), numbers, F.lit("}"))
    text = F.when(F.col("event_id") % 50 == 9, twice).when(F.col("event_id") % 2 == 0, one).otherwise(other)
    # few row groups are few tasks, and the text of a row costs much more than its way
    events = t.events.select("event_id", "user_id", "event_type", "value", "props").repartition(t.spark.sparkContext.defaultParallelism * 4)
    found = events.select("event_id", tx.canonical_json(text).alias("canonical"))
    return found.withColumn("digest", F.sha2(F.col("canonical").cast("binary"), 256))
