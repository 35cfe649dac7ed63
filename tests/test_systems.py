"""Capacity, compatibility, witnesses, rules, accounting, boxes and embedded data against plain loops and edge cases."""

import random

import pytest
from compare import shuffled_rows
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import advisories, aggregates, facts, joins, links, power, ranges, selection, sequences
from plumbline.sources import html, storage

GROUP = "group_id string, mode string, battery_count int, least_c double, most_c double, unit string, limit double, paths array<string>, excluded array<struct<a:string,b:string>>, open boolean"


def test_capacity_checks_shuffle_operations_and_demands_once(spark):
    n, width = 4000, 5
    rows = [(f"g{k}", "m", None, None, None, "W", 10.0, ["p0", f"p{k + 1}"], [("p0", f"p{k + 1}")], False) for k in range(3)]
    groups = spark.createDataFrame(rows, GROUP)
    operations = storage.cut(spark.range(n).select(
        F.col("id").alias("op_id"), F.lit("m").alias("mode"), F.lit(1).alias("battery_count"), F.lit(1.0).alias("temperature_c"), F.array(F.lit("g0"), F.lit("x")).alias("required")
    ))
    demands = storage.cut(spark.range(n * width).repartition(4).select(
        (F.col("id") / width).cast("long").alias("op_id"), F.concat(F.lit("p"), F.col("id") % width).alias("path_id"), F.lit(6.0).alias("value"), F.lit("W").alias("unit")
    ))
    given = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for c in given:
        spark.conf.set(c, "-1")
    before = shuffled_rows(spark)
    got = power.shared_capacity_checks(operations, demands.repartition("op_id"), groups).groupBy("check", "status").count().collect()
    moved = shuffled_rows(spark) - before
    for c, v in given.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sorted(tuple(r) for r in got) == [
        ("capacity_condition_unknown", "UNRESOLVED", n), ("combined_capacity", "BLOCKED", 3 * n), ("demand_capacity_coverage", "UNRESOLVED", 3 * n), ("simultaneous_exclusion", "BLOCKED", 3 * n)
    ]
    # demands and operations for the sums and for the coverage
    assert moved < 2.2 * n * (width + 1)
    with pytest.raises(ValueError, match="2 groups"):
        power.shared_capacity_checks(operations, demands, groups, 2)


def test_capacity_checks_of_every_kind(spark):
    groups = spark.createDataFrame(
        [
            ("g", "m", None, None, None, "W", 10.0, ["p", "q"], [("p", "q")], None),
            ("h", "m", 2, 0.0, 20.0, "W", 5.0, ["p"], [], False),
            ("u", "m", None, None, None, "A", 5.0, ["r"], [], False),
            ("o", "n", None, None, None, "W", 5.0, ["p"], [], True),
            ("t", "n", None, None, None, "W", 5.0, ["p"], [], False),
            ("t", "n", None, None, None, "W", 6.0, ["p"], [], False),
        ],
        GROUP,
    )
    operations = spark.createDataFrame(
        [(1, "m", 2, 20.0, ["g", "h"]), (2, "m", 1, None, ["g"]), (3, "n", 1, 1.0, ["x"]), (4, "m", 2, None, [])],
        "op_id int, mode string, battery_count int, temperature_c double, required array<string>",
    )
    demands = spark.createDataFrame(
        [(1, "p", 5.0, "W"), (1, "q", 5.0, "W"), (1, "r", 1.0, "W"), (2, "p", 11.0, "W"), (2, "q", 0.0, "W"), (3, "p", 1.0, "W")],
        "op_id int, path_id string, value double, unit string",
    )
    got = sorted(tuple(r) for r in power.shared_capacity_checks(operations, demands, groups).fillna(-1.0, ["demand"]).collect())
    assert got == sorted([
        (1, "combined_capacity", "g", "ELIGIBLE", 10.0), (1, "simultaneous_exclusion", "g/p/q", "BLOCKED", -1.0),
        (1, "combined_capacity", "h", "ELIGIBLE", 5.0), (1, "capacity_unit_mismatch", "u", "UNRESOLVED", -1.0),
        (1, "demand_capacity_coverage", "r", "UNRESOLVED", -1.0),
        (2, "combined_capacity", "g", "BLOCKED", 11.0), (2, "simultaneous_exclusion", "g/p/q", "ELIGIBLE", -1.0),
        (2, "capacity_condition_unknown", "h", "UNRESOLVED", -1.0), (2, "combined_capacity", "u", "ELIGIBLE", 0.0),
        (3, "capacity_condition_unknown", "x", "UNRESOLVED", -1.0), (3, "capacity_condition_unknown", "o", "UNRESOLVED", -1.0),
        (3, "capacity_condition_unknown", "t", "UNRESOLVED", -1.0), (3, "demand_capacity_coverage", "p", "UNRESOLVED", -1.0),
        (4, "combined_capacity", "g", "ELIGIBLE", 0.0), (4, "simultaneous_exclusion", "g/p/q", "ELIGIBLE", -1.0),
        (4, "capacity_condition_unknown", "h", "UNRESOLVED", -1.0), (4, "combined_capacity", "u", "ELIGIBLE", 0.0),
    ])


def test_compatibility_checks(spark):
    df = spark.createDataFrame(
        [(5.0, 5.0, ["A-b", "", "ab"], ["AB "]), (5.1, 5.0, ["x"], []), (None, 5.0, [], ["x"]), (5.0, None, ["x", "y"], ["x"]), (5.0, 9.0, ["x"], None)],
        "need double, limit double, want array<string>, have array<string>",
    )
    out = df.select(
        selection.limit_check(F.col("need"), F.col("limit")).alias("l"), selection.supplied_check(F.col("want"), F.col("have")).alias("s"),
        selection.limit_check(F.col("need"), F.col("limit"), F.lit(True)).alias("la"), selection.supplied_check(F.col("want"), F.col("have"), F.lit(True)).alias("sa"),
    ).collect()
    assert [r.l for r in out] == ["compatible", "incompatible", None, "unknown", "compatible"]
    assert [r.la for r in out] == ["compatible", "incompatible", "unknown", "unknown", "compatible"]
    assert [r.s for r in out] == ["compatible", "unknown", None, "incompatible", None]
    assert [r.sa for r in out] == ["compatible", "unknown", None, "incompatible", "unknown"]
    rows = [(1.0, 1.0, 1.0), (1.0, 1.5, 1.0), (1.0, None, 1.0), (None, 1.0, None), (1.0, 1.0, None)]
    sizes = spark.createDataFrame(rows, "space double, inside double, body double")
    three = lambda c: [F.col(c), F.lit(0.5), F.lit(0.5)] if c == "inside" else [F.col(c), F.when(F.col(c).isNotNull(), 0.5), F.when(F.col(c).isNotNull(), 0.5)]
    fits = [r[0] for r in sizes.select(selection.fit_check(three("space"), three("body"), three("inside"))).collect()]
    assert fits == ["compatible", "incompatible", "unknown", None, "unknown"]


def test_missing_ports_and_paths_are_placeholders(spark):
    bindings = spark.createDataFrame([(1,), (2,), (3,)], "b int")
    ports = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "b int, p int")
    paths = spark.createDataFrame([(10, "x"), (10, "y"), (20, "z")], "p int, path string")
    got = {(r.b, r.p, r.path, r.has_port, r.has_path) for r in selection.enumerate_witnesses(bindings, ports, paths, ["b"], ["p"]).collect()}
    assert got == {(1, 10, "x", True, True), (1, 10, "y", True, True), (1, 11, None, True, False), (2, 20, "z", True, True), (3, None, None, False, False)}


@pytest.mark.parametrize("cell", [(3.0, 2.0), (50.0, 50.0), (0.7, 0.9)])
def test_box_overlaps_are_brute_force(spark, cell):
    rng = random.Random(2)
    boxes = [(rng.randint(0, 1), i, *(v for _ in "xy" for v in sorted((rng.randint(-20, 20) / 2, rng.randint(-20, 20) / 2)))) for i in range(80)]
    boxes += [(0, 100, 0.0, 0.0, 0.0, 5.0), (0, 101, 1.0, None, 0.0, 5.0)]
    df = spark.createDataFrame(boxes, "k int, i int, x0 double, x1 double, y0 double, y1 double")
    want = {
        (a[0], a[1], b[1]) for a in boxes for b in boxes
        if a[0] == b[0] and a[1] < b[1] and None not in (*a, *b) and all(x[2] < x[3] and x[4] < x[5] for x in (a, b))
        and max(a[2], b[2]) < min(a[3], b[3]) and max(a[4], b[4]) < min(a[5], b[5])
    }
    got = [tuple(r) for r in ranges.box_overlaps(df, ["k"], "i", cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_rules_of_a_revision(spark):
    rules = spark.createDataFrame(
        [("a", 1, "exact", "Rated Power", "power", "x"), ("b", 1, "pattern", "power$", "power", "y"), ("c", 1, "pattern", "^peak", "power", "z"), ("d", 2, "pattern", ".", None, "w")],
        "rule_id string, revision int, kind string, pattern string, dimension string, projection string",
    )
    rows = [(" peak load ", "power", 1), ("rated power", "power", 1), ("max power", "energy", 1), ("other", "power", 1), (None, "power", 1), ("x", None, 2), ("x", None, 3)]
    df = spark.createDataFrame(rows + rows[:1], "label string, dimension string, revision int")
    got = {(r.label, r.revision): (r.rule_code, r.rule_id, r.projection) for r in facts.apply_rules(df, rules).collect()}
    assert got == {
        (" peak load ", 1): ("mapped", "c", "z"), ("rated power", 1): ("ambiguous", None, None), ("max power", 1): ("dimension_conflict", None, None),
        ("other", 1): ("unmapped", None, None), (None, 1): ("unmapped", None, None), ("x", 2): ("mapped", "d", "w"), ("x", 3): ("unmapped", None, None),
    }
    assert facts.apply_rules(df, rules).count() == 8
    with pytest.raises(ValueError, match="3"):
        facts.apply_rules(df, rules, 3)


def test_parts_account_for_every_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 20), (3, 20), (None, 7)], "i int, x int")
    parts = facts.disjoint_parts(df, [("big", F.col("x") > 10), ("odd", F.col("x") % 2 == 1)], "rest")
    assert sorted((str(r.i), r.part) for r in parts.collect()) == [("1", "odd"), ("2", "rest"), ("3", "big"), ("3", "big"), ("None", "odd")]
    assert facts.accounting(df, parts, "i").count() == 0
    off = {r.i: (r.n_given, r.n_accounted) for r in facts.accounting(df, parts.where("part <> 'odd'").unionByName(parts.where("i = 2")), "i").collect()}
    assert off == {1: (1, 0), None: (1, 0), 2: (1, 2)}


def test_targets_that_all_members_have(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "b", 6), (1, "b", 6), (2, "a", 7), (3, "a", 1), (3, "b", None)], "k int, m string, t int")
    assert {(r.k, r.t) for r in links.common_targets(df, ["k"], "m", "t").collect()} == {(1, 5), (2, 7)}


def test_embedded_json_states(spark):
    script = '<script type="application/json" id="d">%s</script>'
    pages = [
        (1, "<p>" + script % '{"a": "<p>"}'), (2, script % "1" + script % "1"), (3, script % "{"), (4, "<p>no"), (5, None), (6, f"<!-- {script % 1} -->"),
        (7, "<script\n ID = d type = 'Application/JSON; charset=x' >\n[1]\n</script >"), (8, script.replace('id="d"', 'data-id="d"') % "1"),
    ]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = {r.page_id: (r.json_status, r.json) for r in html.embedded_json(df, "d").collect()}
    assert got == {
        1: ("found", '{"a": "<p>"}'), 2: ("ambiguous", None), 3: ("invalid", None), 4: ("not_found", None), 5: ("missing_text", None), 6: ("not_found", None),
        7: ("found", "\n[1]\n"), 8: ("not_found", None),
    }
    ld = "<script type='application/ld+json'>{}</script><script type='application/ld+json'>{</script><script type='application/ld+json'>[]</script>"
    assert [tuple(r) for r in html.linked_data(spark.createDataFrame([(1, ld), (2, None)], "page_id int, html string")).collect()] == [(1, 1, "{}"), (1, 3, "[]")]


def test_html_blocks_of_all_pages_are_the_plain_loop(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = [(r.page_id, k, b["kind"], b["text"], b["section"]) for r in pages.collect() for k, b in enumerate(html.blocks_of(r.html))]
    got = [(r.page_id, r.seq, r.kind, r.text, r.section) for r in html.html_blocks(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > pages.count()


def test_first_rows_ordinals_and_members(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("j", 5, None)], "k string, i int, v string")
    assert {tuple(r) for r in sequences.first_of(df, ["k"], ["i", "v"]).collect()} == {("k", 1, "a"), ("j", 5, None)}
    got = {(r.k, r.v, r.n) for r in sequences.ordinals(df, [], "k", ["i", "v"], "n").collect()}
    assert got == {("k", "a", 1), ("k", "z", 2), ("k", "b", 3), ("j", None, 1)}
    rows = aggregates.group_rows(df, [F.col("k")], "i", ["name"]).collect()
    assert sorted(tuple(r) for r in rows) == [("j", 5), ("k", 1), ("k", 2)]


def test_coded_left_and_required_sets(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "v")], "k int, x string")
    assert {(r.k, r.x, r.code) for r in joins.coded_left(left, right, ["k"], "hit", "miss").collect()} == {(1, "v", "hit"), (2, None, "miss")}
    df = spark.createDataFrame([(["A ", "b"], ["a", "B", "c"]), (["a"], []), ([], [])], "n array<string>, o array<string>")
    assert [r[0] for r in df.select(selection.contains_all(F.col("n"), F.col("o"))).collect()] == [True, False, True]


def test_taken_captures_are_the_plain_loop(spark):
    rng = random.Random(9)
    rows = [(h, i, rng.random() < 0.3, rng.randint(0, 2), None if rng.random() < 0.05 else rng.randint(1, 60)) for h in "abc" for i in range(rng.randint(5, 40))]
    df = spark.createDataFrame(rows, "h string, i int, o boolean, t int, s int")
    got = {(r.h, r.i): (r.place, r.taken) for r in facts.budgeted_captures(df, ["h"], F.col("o"), ["t", "i"], F.col("s"), 25, 8, 150).collect()}
    want = {}
    for h in "abc":
        n = used = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == h), key=lambda r: (not r[2], r[3], r[1]))[:25], 1):
            fits = n < 8 and used + (r[4] or 0) <= 150
            n, used = n + fits, used + fits * (r[4] or 0)
            want[h, r[1]] = (place, fits)
    assert got == want and {True, False} == {t for _, t in want.values()}


def test_fields_in_context(spark):
    mappings = spark.createDataFrame(
        [("a b", None, None, "x", "t"), ("A  B", "r", "e", "y", "t"), ("c", None, None, "p", "t"), ("C", None, None, "q", "t"), ("d", "r", "e", "z", "u"), ("a b", "s", "e", "x1", "t"), ("a b", "s", "e", "x2", "t")],
        "alias string, role string, region string, canonical_field string, value_kind string",
    )
    rows = [(" A b", "v", None, None), ("a b", "v", "r", "e"), ("a b", "v", "r", "f"), ("a b", "v", "s", "e"), ("c", "v", None, None), ("d", "v", "r", "e"), ("d", "v", None, None), (None, "v", "r", "e"), ("a b", None, None, None)]
    df = spark.createDataFrame(rows, "label string, value string, role string, region string").coalesce(1)
    got = sorted((str(r.label), str(r.value), str(r.role), str(r.region), r.field_code, str(r.canonical_field)) for r in facts.map_fields(df, mappings, {"t": F.upper}).collect())
    assert got == sorted([
        (" A b", "v", "None", "None", "mapped", "x"), ("a b", "v", "r", "e", "mapped", "y"), ("a b", "v", "r", "f", "mapped", "x"), ("a b", "v", "s", "e", "ambiguous", "None"),
        ("c", "v", "None", "None", "ambiguous", "None"), ("d", "v", "r", "e", "invalid_value", "z"), ("d", "v", "None", "None", "unmapped", "None"),
        ("None", "v", "r", "e", "unmapped", "None"), ("a b", "None", "None", "None", "invalid_value", "x"),
    ])


def test_records_that_collide_are_not_written(spark, tmp_path):
    stored = spark.createDataFrame([(1, "m", "p"), (2, "n", None)], "i int, maker string, part string")
    new = spark.createDataFrame([(3, "m", "q"), (4, "n", None)], "i int, maker string, part string")
    keys = [["i"], ["maker", "part"]]
    for bad in (spark.createDataFrame([(1, "x", "y")], stored.schema), spark.createDataFrame([(9, "m", "p")], stored.schema), new.unionByName(new.where("i = 3").withColumn("i", F.lit(7)))):
        with pytest.raises(ValueError, match="collide"):
            storage.create_unless_colliding(bad, keys, stored, str(tmp_path / "new"))
    storage.create_unless_colliding(new, keys, stored, str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2


def test_lists_hold_their_values(spark):
    df = spark.createDataFrame([("list", [1, 2], 2), ("list", [1], 2), ("list", None, 2), ("scalar", [2], 2), ("other", [2], 2)], "k string, xs array<int>, v int")
    none = F.lit(None).cast("int")
    assert [r[0] for r in df.select(ranges.includes_value(F.col("k"), F.lit(2), none, none, F.col("v"), F.col("xs"))).collect()] == [True, False, None, True, None]


def test_sources_of_one_event_count_once(spark):
    adv = spark.createDataFrame([(1, ["a", "b", "c"])], "id int, evidence_ids array<string>").withColumn("policy_action", F.lit("caution"))
    rows = [("a", "recall", "active", "verified", "e", "s1"), ("b", "recall", "active", "verified", "e", "s2"), ("c", "recall", "active", "verified", None, "s3")]
    ev = spark.createDataFrame(rows, "id string, type string, status string, verification_status string, event_key string, source_key string")
    assert advisories.assess(adv, ev).first().independent_sources == 2


def test_bindings_of_two_interfaces(spark):
    candidates = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    ports = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "i int, port string")
    paths = spark.createDataFrame([(1, "p", "q", "x"), (1, "p", "q", "y"), (2, "z", "r", "w")], "i int, source string, target string, path string")
    args = candidates, "i", ["a", "b"], [("m", "a", "b")], ports, paths
    got = sorted((tuple(r) for r in selection.product_witnesses(*args, 5).collect()), key=str)
    assert got == sorted(
        [(1, "p", "p", None), (1, "p", "q", "x"), (1, "p", "q", "y"), (1, "q", "p", None), (1, "q", "q", None), (2, "r", "r", None), (3, None, None, None)], key=str
    )
    for bound in (3, 4):
        with pytest.raises(ValueError, match=str(bound)):
            selection.product_witnesses(*args, bound)


def test_bindings_of_ports_are_not_shuffled(spark):
    """Ports and paths are; their combinations are not, and two paths with the same ends, or ports told twice, count each."""
    n, width = 200, 30
    candidates = spark.range(n + 1).withColumnRenamed("id", "i")
    ports = spark.range(n * width).select((F.col("id") % n).alias("i"), F.col("id").alias("port"))
    paths = ports.select("i", F.col("port").alias("source"), (F.col("port") + n).alias("target"), F.lit("x").alias("path"))
    given = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in given:
        spark.conf.set(k, "-1")
    before = shuffled_rows(spark)
    out = selection.product_witnesses(candidates, "i", ["a", "b"], [("m", "a", "b")], ports, paths, width * width)
    got = out.groupBy("i").agg(F.count("*").alias("n"), F.count("via_m").alias("m")).groupBy("n", "m").count().collect()
    moved = shuffled_rows(spark) - before
    for k, v in given.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {tuple(r) for r in got} == {(1, 0, 1), (width * width, width - 1, n)}
    assert moved < n * width * width / 2

    one = spark.createDataFrame([(1,), (1,), (None,), (None,)], "i int")
    twice = spark.createDataFrame([(1, "p"), (1, "p"), (1, None), (None, "p"), (5, "p")], "i int, port string")
    many = spark.createDataFrame([(1, "p", "p", None), (1, "p", "p", "y"), (5, "p", "p", "a"), (5, "p", "p", "b")] + [(1, "p", "z", "w")] * 99, "i int, source string, target string, path string")
    for rules, rows in (([("m", "a", "b")], 13), ([("m", "a", "b"), ("k", "b", "a")], 21), ([("m", "a", "a")], 15)):
        assert selection.product_witnesses(one, "i", ["a", "b"], rules, twice, many, rows).where("i = 1").count() == 2 * rows
        with pytest.raises(ValueError, match="paths"):
            selection.product_witnesses(one, "i", ["a", "b"], rules, twice, many, rows - 1)
    assert selection.product_witnesses(one, "i", ["a", "b"], [("m", "a", "b")], twice, many, 13).where("i is null").count() == 2
    with pytest.raises(ValueError, match="interfaces"):
        selection.product_witnesses(one, "i", ["a", "b"], [("m", "a", "c")], twice, many, 99)


def test_identities_are_bounded(spark):
    rows = [("x MP-II 48/3000 y", "mp ii 48/3000", True), ("MPII", "MP", False), ("é-MP%20II", "mp_ii", True), ("amp", "mp", False), ("mp amp mp.", "MP", True), ("a.b", "a+b", False), ("axb", "a.b", False),
            ("x", "", False), ("x", None, False), (None, "x", False), ("100% mp", "mp", True), ("a\\\\Eb c", "a\\\\Eb", True), ("éa", "a", False)]
    df = spark.createDataFrame(rows, "t string, i string, want boolean").coalesce(1)
    assert [r.got for r in df.select(tx.contains_identity(F.col("t"), F.col("i")).alias("got")).collect()] == [r[2] for r in rows]


def test_semi_join_by_either_key_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (2, "b", 8), (None, "c", 7), (3, None, 6)], "k int, x string, y int")
    right = spark.createDataFrame([(1, "q", 1), (5, "b", 8), (None, None, 6), (1, "a", 9)], "k int, x string, y int")
    got = sorted(tuple(r) for r in joins.either_key_semi(left, right, [["k"], ["x", "y"]]).collect())
    assert got == [(1, "a", 9), (1, "a", 9), (2, "b", 8)]


def test_scenario_envelope_sums_exactly(spark, tmp_path):
    """Sums of doubles lose what is added to a large one: 10,000 cents beside 100,000,000,000 were off by some cents."""
    import __spark_entry__

    rows = spark.range(0, 10_001, 1, 1).selectExpr(
        "id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus", "IF(id = 0, 100000000000D, 0.01D) AS o_totalprice"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    (row,) = __spark_entry__.queries()["scenario_envelope"](spark, str(tmp_path)).collect()
    assert (row.max_power, row.power_governors) == (100_000_000_100.0, "O")


@pytest.mark.parametrize("share", [7, 25_000])
def test_interval_join_is_brute_force(spark, monkeypatch, share):
    """Unknown and touching ends, spans without an inside or over many buckets, copies, and buckets dealt over shares."""
    monkeypatch.setattr(ranges, "SHARE", share)
    rng = random.Random(5)
    at = [(i, rng.choice([None, float("nan"), -0.0, 12.0, *(rng.randint(-80, 160) / 2 for _ in range(6))])) for i in range(300)]
    spans = [(i, None if i % 41 == 0 else low, low + rng.choice([-1.0, 0.0, 0.5, 4.0, 9.5, 60.0])) for i in range(200) for low in [rng.randint(-80, 160) / 2]]
    points = spark.createDataFrame(at, "i int, v double")
    got = [tuple(r) for r in ranges.interval_join(points, "v", spark.createDataFrame(spans, "j int, lo double, hi double"), "lo", "hi", 10.0).collect()]
    want = [(i, v, *s) for i, v in at for s in spans if None not in (v, s[1]) and s[1] <= v < s[2]]
    assert sorted(got) == sorted(want) and len({r[0] for r in want}) > 100
    kept = ranges.interval_join(points, "v", spark.createDataFrame(spans, "j int, lo double, hi double"), "lo", "hi", 10.0, ["i", "j"])
    assert kept.columns == ["i", "j"] and sorted(map(tuple, kept.collect())) == sorted((r[0], r[2]) for r in want)


def test_files_of_interval_pairs_stay_small(spark, tmp_path):
    """Each copy of the tables multiplies the pairs; one took 1.5 bytes in a file here, as points came in no order."""
    points = storage.cut(spark.range(3000).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("v")))
    low = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double")
    spans = storage.cut(spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("j"), low.alias("lo"), (low + 30).alias("hi")))
    ranges.interval_join(points, "v", spans, "lo", "hi", 50.0).select("i", "j").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert pairs == points.join(spans, (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi"))).count() > 2_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * pairs
