"""Table cells, text lines and ruled cells against hand-written rows and plain loops; backward demand and digests by hand."""

import random

import pytest
from compare import shuffled_rows
from pyspark.sql import functions as F

from plumbline.operators import layout, links, selection, sequences
from plumbline.sources import html, storage

PAGE = """<h1>Data</h1><p>About <b>it</b><table><caption>Sizes</caption><tr><th colspan=2 scope="COL">Model<th rowspan='2'>Mass</tr>
<tr><td>A&amp;B</td><td>10<sup>2</sup> m<sub>x</sub> n</td></tr><tr></tr>
<tr><td rowspan=99>c <table><tr><td>inner</td></tr></table> rest<td rowspan="0" colspan="x">d<td>e</table>
<script>"<table><tr><td>no"</script><!-- <table><tr><td>no --><dl><dt>Mass<dd>4 kg</dl><ul><li>one<li>two</ul>"""


def test_cells_of_a_page_by_hand(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<table></table>"), (5, "<td>bare")], "page_id long, html string")
    cells = layout.table_cells(pages)
    got = layout.placed_cells(cells, ["page_id", "table"], "row", "seq", "row_span", "column_span").orderBy("table", "row", "seq").collect()
    assert [(r.row, r.text, r.header, r.scope, r.row_span, r.column_span) for r in got] == [
        (0, "Model", True, "col", None, 2), (0, "Mass", True, None, 2, None), (1, "A&B", False, None, None, None), (1, "102 mx n", False, None, None, None),
        (3, "c rest", False, None, 99, None), (3, "d", False, None, None, None), (3, "e", False, None, None, None), (0, "inner", False, None, None, None),
    ]
    assert [(r.first_column, r.end_column, r.end_row, r.overlaps) for r in got] == [
        (0, 2, 1, False), (2, 3, 2, False), (0, 1, 2, False), (1, 2, 2, False), (0, 1, 4, False), (1, 2, 4, False), (2, 3, 4, False), (0, 1, 1, False),
    ]
    assert [tuple(x) for x in got[3].runs] == [("text", "10"), ("superscript", "2"), ("text", "m"), ("subscript", "x"), ("text", "n")] and got[0].runs is None


def test_cells_that_cross_are_marked(spark):
    rows = [("t", 0, 0, 1, 1), ("t", 0, 1, 3, 1), ("t", 1, 0, 1, 3), ("t", 1, 1, 1, 1), ("t", 2, 0, 1, 1), ("t", 3, 0, None, -4), (None, 0, 0, 2, 5000), (None, 1, 0, 1, 1)]
    cells = spark.createDataFrame(rows, "name string, row int, seq int, high int, wide int").withColumn("first", F.lit("clash"))
    got = layout.placed_cells(cells, ["name"], "row", "seq", "high", "wide")
    by = {(r.name, r.row, r.seq): (r.first_column, r.end_column, r.end_row, r.overlaps) for r in got.where("name IS NOT NULL").collect()}
    assert by == {
        ("t", 0, 0): (0, 1, 1, False), ("t", 0, 1): (1, 2, 3, False), ("t", 1, 0): (0, 3, 2, True), ("t", 1, 1): (3, 4, 2, False),
        ("t", 2, 0): (0, 1, 3, False), ("t", 3, 0): (0, 1, 4, False),
    }
    assert layout.placed_cells(cells.where("false"), ["name"], "row", "seq", "high", "wide").count() == 0


def test_pages_are_parsed_once_and_dealt_once(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    placed = layout.placed_cells(layout.table_cells(pages), ["page_id", "table"], "row", "seq", "row_span", "column_span")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.count("Exchange ") == 1


def test_spans_in_any_quotes(spark):
    tags = """<table><tr><td rowspan=2 colspan='3'>a<TD data-colspan="7" COLSPAN = "4">b<td rowspan='"2"' scope="">c<td colspan=''>d<td colspan="5>e</table>"""
    got = layout.table_cells(spark.createDataFrame([(1, tags)], "page_id long, html string")).orderBy("seq").collect()
    assert [(r.text, r.row_span, r.column_span, r.scope) for r in got] == [("a", 2, 3, None), ("b", None, 4, None), ("c", None, None, None), ("d", None, None, None), ("e", None, None, None)]


def test_html_blocks_by_hand(spark):
    """Rows written by hand, not by the parser."""
    got = html.html_blocks(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).orderBy("seq").collect()
    assert [(r.kind, r.text) for r in got if r.kind != "table"] == [
        ("heading", "Data"), ("paragraph", "About it"), ("definition", "Mass: 4 kg"), ("list", "one two"),
    ]
    assert {r.section for r in got} == {"Data"}


def plain_lines(glyphs):
    found, line, reach = {}, -1, None
    for bottom, top, i in sorted((b, t, i) for i, b, t in glyphs):
        if reach is None or bottom >= reach:
            line, reach = line + 1, top
        found[i], reach = line, max(reach, top)
    return found


def test_lines_of_one_very_long_page_are_split_over_tasks(spark, monkeypatch):
    rng = random.Random(4)
    glyphs = []
    for i in range(20_000):
        bottom = rng.randint(0, 400_000)
        glyphs.append((i, float(bottom), float(bottom + rng.choice([2, 5, 9, 30]))))
    glyphs += [(20_000, 5.0, 100_000.0), (20_001, 300_000.0, 380_000.0)]
    df = spark.createDataFrame([("long", *g) for g in glyphs] + [("short", 1, 0.0, 1.0), ("short", 2, 1.0, 2.0), ("none", 3, 1.0, 1.0), ("none", 4, None, 2.0)], "page string, id long, bottom double, top double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = []
    try:
        monkeypatch.setattr(layout, "cut", lambda df: parts.append(storage.cut(df)) or parts[-1])
        got = layout.text_lines(df.repartition(7), ["page"], "id")
        assert parts[0].where("page = 'long'").select("_part").distinct().count() > 4
        assert {r.id: r.line for r in got.where("page = 'long'").collect()} == plain_lines(glyphs)
        assert sorted((r.id, r.line) for r in got.where("page <> 'long'").collect()) == [(1, 0), (2, 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_rules_are_those_of_a_plain_loop(spark):
    rng = random.Random(8)
    rules = [(p, k, *sorted((rng.randint(0, 60), rng.randint(0, 60))), y, y - rng.choice([0, 1])) for p in "ab" for k, y in enumerate(rng.choices(range(40), k=300))]
    items = [(p, k, x, x + rng.randint(0, 9), rng.randint(0, 40)) for p in "ab" for k, x in enumerate(rng.choices(range(60), k=300))]
    want = set()
    for p, i, low, high, at in items:
        fits = [(y, k) for q, k, a, b, y, edge in rules if q == p and a <= low and high <= b and edge >= at]
        if fits:
            want.add((p, i, min(fits)[1], float(min(fits)[0])))
    asked = spark.createDataFrame(items, "page string, id long, low int, high int, at int").repartition(3)
    lines = spark.createDataFrame(rules, "page string, rule long, low int, high int, at int, edge int").repartition(3)
    for width in (1.0, 7.0, 1000.0):
        assert {tuple(r) for r in layout.nearest_cover(asked, lines, ["page"], width).collect()} == want
    assert layout.nearest_cover(asked.where("false"), lines, ["page"], 5.0).count() == 0


def test_nearest_rules_over_many_batches_and_with_equal_hashes(spark, monkeypatch):
    rng = random.Random(9)
    rules = [(p, k, *sorted((rng.randint(0, 60), rng.randint(0, 60))), y, y) for p in ("a", "b", None) for k, y in enumerate(rng.choices(range(40), k=60))]
    items = [(p, k, x, x + rng.randint(0, 9), rng.randint(0, 40)) for p in ("a", "b", None) for k, x in enumerate(rng.choices(range(60), k=60))]
    want = set()
    for p, i, low, high, at in items:
        fits = [(y, k) for q, k, a, b, y, edge in rules if q == p and a <= low and high <= b and edge >= at]
        if fits:
            want.add((p, i, min(fits)[1], float(min(fits)[0])))
    asked = spark.createDataFrame(items, "page string, id long, low int, high int, at int")
    lines = spark.createDataFrame(rules, "page string, rule long, low int, high int, at int, edge int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in layout.nearest_cover(asked, lines, ["page"], 9.0).collect()} == want
        monkeypatch.setattr(layout.F, "xxhash64", lambda *_: F.lit(-6).cast("long"))
        assert {tuple(r) for r in layout.nearest_cover(asked, lines, ["page"], 9.0).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_boxes_go_to_python_once_for_two_sides(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(layout, "cut", lambda df: tables.append(1) or storage.cut(df))
    rules = spark.createDataFrame([], "page string, rule long, x0 double, x1 double, y0 double, y1 double, ink double")
    boxes = spark.createDataFrame([], "page string, id long, x0 double, x1 double, y0 double, y1 double")
    plan = layout.grid_cells(boxes, rules, ["page"], 10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and not tables


def test_ruled_cells_by_hand(spark):
    """Four cells of a 2 x 2 grid: one with two boxes, one empty, one that a box crosses, one with one box."""
    level = [("p", k, 0.0, 20.0, y, y, 0.5) for k, y in enumerate((0.0, 10.0, 20.0))]
    upright = [("p", 10 + k, x, x, 0.0, 20.0, 0.5) for k, x in enumerate((0.0, 10.0, 20.0))]
    rules = spark.createDataFrame(level + upright, "page string, rule long, x0 double, x1 double, y0 double, y1 double, ink double")
    boxes = [("p", 1, 1.0, 4.0, 1.0, 3.0), ("p", 2, 5.0, 9.0, 4.0, 9.0), ("p", 3, 11.0, 15.0, 11.0, 15.0), ("p", 4, 12.0, 14.0, 16.0, 25.0), ("p", 5, 11.0, 19.0, 1.0, 9.0), ("q", 6, 1.0, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(boxes, "page string, id long, x0 double, x1 double, y0 double, y1 double")
    got = layout.grid_cells(df, rules, ["page"], 10.0).collect()
    assert sorted((r.left, r.right, r.bottom, r.top, r.n_items, r["items"]) for r in got) == [(0.0, 10.0, 0.0, 10.0, 2, [1, 2]), (10.0, 20.0, 0.0, 10.0, 1, [5])]


def test_cells_of_whole_pages_and_of_crowded_ones_are_the_same(spark, monkeypatch):
    """Pages without a key, boxes of one id, without an id, upside down, without an inside or with an unknown side, and pages of several sizes."""
    rng = random.Random(4)
    pages = {"a": 12, "b": 80, "c": 300, "d": 5, None: 40}
    ruled = lambda p, k, at, low, high, up: (p, k, *((at, at, low, high) if up else (low, high, at, at)), rng.choice([0.0, 0.5, None] if k % 29 == 0 else [0.5]))
    rules = [ruled(p, k, 10.0 * rng.randint(-2, 8), *sorted((10.0 * rng.randint(-2, 3), 10.0 * rng.randint(3, 9))), k % 2) for p, n in pages.items() for k in range(n)]
    boxes = []
    for p, n in pages.items():
        for k in range(4 * n):
            x, y = 10.0 * rng.randint(-2, 8) + rng.choice([1.0, 1.5, 7.0]), 10.0 * rng.randint(-2, 8) + rng.choice([1.0, 2.0])
            wide, high = rng.choice([1.0, 2.0, 2.0, 0.0]), rng.choice([1.0, 2.0, 3.0, -1.0 if k % 9 == 0 else 1.0])
            sides = [x, x + wide, y, y + high]
            if k % 23 == 0:
                sides[rng.randrange(4)] = None
            boxes.append((p, None if k % 31 == 0 else k - k % 2 if k % 7 == 0 else k, *sides))
    boxes += [("a", -1, 1.0, 2.0, 30.0, float("inf")), ("d", -2, float("-inf"), float("inf"), 1.0, 2.0)]
    lines = spark.createDataFrame(rules, "page string, rule long, x0 double, x1 double, y0 double, y1 double, ink double").repartition(3)
    df = spark.createDataFrame([b for b in boxes if b[1] not in (-1, -2)], "page string, id long, x0 double, x1 double, y0 double, y1 double").repartition(3)
    cells = lambda df: sorted((r.page, r.left, r.right, r.bottom, r.top, r.n_items, tuple(r["items"])) for r in layout.grid_cells(df, lines, ["page"], 7.0).collect())
    want = cells(df)
    assert len(want) > 15 and len({r[0] for r in want}) > 2 and any(r[5] > 1 for r in want)
    for most in (100, 0):
        monkeypatch.setattr(layout, "PAGE", most)
        assert cells(df) == want
    monkeypatch.undo()
    # a box without an end stops at nothing, and costs no more than any other
    endless = cells(spark.createDataFrame(boxes, df.schema))
    assert {r for r in endless if r[0] not in ("a", "d")} == {r for r in want if r[0] not in ("a", "d")} and not any({-1, -2} & set(r[6]) for r in endless)


def test_a_page_is_dealt_once(spark):
    """Boxes were shuffled for level lines, for upright ones and once more for the cells: 11 rows of a line in all."""
    import __spark_entry__

    before = shuffled_rows(spark)
    __spark_entry__.queries()["grid_cells"](spark, "/root/testdata/sf0.001").count()
    assert shuffled_rows(spark) - before < 6.5 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_backward_demand_by_hand(spark):
    edges = [
        (1, 1, 90.0, True, False, None, None, 200.0, 100.0), (1, 2, 90.0, True, True, 0.5, 100.0, None, 150.0), (1, 3, 90.0, True, False, None, None, 80.0, None),
        (2, 1, 10.0, True, False, None, None, None, None), (2, 2, 10.0, False, False, None, None, None, None), (2, 3, 10.0, True, True, 0.5, None, None, None),
        (3, 1, 10.0, True, True, 0.5, 5.0, None, None), (3, 2, 10.0, True, True, 1.5, 50.0, None, None), (4, 1, None, True, False, None, None, None, None),
    ]
    df = spark.createDataFrame(edges, "route int, k int, demand double, usable boolean, converts boolean, eff double, rating double, to_limit double, from_limit double")
    got = sequences.demand_backwards(df, ["route"], ["k"], "demand", "usable", "converts", "eff", "rating", "to_limit", "from_limit")
    assert [(r.route, r.k, r.to_w, r.from_w, r.status) for r in got.orderBy("route", "k").collect()] == [
        (1, 1, 180.0, 180.0, "blocked"), (1, 2, 90.0, 180.0, "blocked"), (1, 3, 90.0, 90.0, "blocked"),
        (2, 1, None, None, "unresolved"), (2, 2, None, None, "unresolved"), (2, 3, 10.0, 20.0, "unresolved"),
        (3, 1, None, None, "unresolved"), (3, 2, 10.0, None, "unresolved"), (4, 1, None, None, "unresolved"),
    ]


def test_faults_of_artifacts_reach_all_that_rest_on_them(spark, monkeypatch):
    made = []
    cut = storage.cut
    monkeypatch.setattr(links, "cut", lambda df: made.append(1) or cut(df))
    n = 400  # 100 chains of four, a ring, and one that names an old digest
    artifacts = [(i, "x" if i % 100 == 7 else f"d{i}", f"d{i}") for i in range(n)] + [(1000, None, "d1000"), (1001, "d1001", "d1001"), (1002, "d1002", "d1002")]
    references = [(i, i - 100, f"d{i - 100}") for i in range(100, n)] + [(5, 5, "d5"), (9, 309, "d309"), (350, 150, "old"), (1001, 1000, "d1000"), (1002, 4711, "d4711"), (1002, 4711, "d4711")]
    a = spark.createDataFrame(artifacts, "id long, claimed string, actual string")
    r = spark.createDataFrame(references, "id long, target long, digest string")
    got = {x.id: (x.state, x.round) for x in links.verified_artifacts(a, r, "id", "claimed", "actual").collect()}
    assert len(got) == n + 3
    assert [got[i] for i in (7, 107, 207, 307)] == [("altered", 0)] * 4
    assert got[350] == ("dangling", 0) and got[250] == ("verified", None) and got[5] == got[9] == got[309] == ("verified", None)
    assert got[1000] == ("altered", 0) and got[1001] == ("unsupported", 1) and got[1002] == ("dangling", 0)
    chain = spark.createDataFrame([(i, "x" if i == 0 else "d", "d") for i in range(30)], "id long, claimed string, actual string")
    made.clear()
    up = spark.createDataFrame([(i, i - 1 if i % 10 else i // 10 - 1, "d") for i in range(1, 30)], "id long, target long, digest string")
    depth = max(x.round or 0 for x in links.verified_artifacts(chain, up, "id", "claimed", "actual").collect())
    assert 9 <= depth <= 12 and len(made) == 3 + 2 * (depth + 1)  # two tables a step and one to see that none is left


def test_a_group_of_too_many_options_is_an_error(spark):
    options = spark.range(1100).select("id", (F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    with pytest.raises(ValueError, match="beyond"):
        selection.tiered_pairs(options, [], "id", [[("x", True)]])
    assert selection.tiered_pairs(options, ["g"], "id", [[("x", True)]]).count() == 2 * 550 * 549 // 2
