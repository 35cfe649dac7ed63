"""Edge cases: unknown values, empty sets, ties, gaps, bounds and ambiguity."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import electrical as el
from plumbline.functions import lattices as la
from plumbline.functions import text as tx
from plumbline.operators import advisories, aggregates, facts, joins, links, selection, sequences
from plumbline.operators import battery as bt
from plumbline.sources import html, storage, tables


def one(df):
    (row,) = df.collect()
    return row


def test_complete_and_known_sums(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "k int, x double")
    got = {r.k: (r.c, r.s) for r in df.groupBy("k").agg(aggregates.complete_sum(F.col("x")).alias("c"), aggregates.known_sum(F.col("x")).alias("s")).collect()}
    assert got == {1: (None, 2.0), 2: (3.0, 3.0)}


def test_worst_status_and_empty_sets(spark):
    df = spark.createDataFrame([(1, "PASS"), (1, "FAIL"), (2, None)], "k int, s string")
    got = dict(df.groupBy("k").agg(la.worst(F.col("s"), la.SEVERITY, "CONDITIONAL").alias("w")).collect())
    assert got == {1: "FAIL", 2: "CONDITIONAL"}


def test_governors_keep_ties_and_unknowns(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, None), ("b", 4, None)], "g string, i int, v double")
    got = {r.g: tuple(r)[1:] for r in aggregates.governors(df, ["g"], "i", "v").collect()}
    assert got == {"a": (5.0, 2, 1, 1, 3, "unresolved"), "b": (None, 0, None, 1, 4, "unresolved")}
    rows = {(r.g, r.i): r.role for r in aggregates.governor_rows(df, ["g"], "v").collect()}
    assert rows == {("a", 1): "governing", ("a", 2): "governing", ("a", 3): "unresolved", ("b", 4): "unresolved"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=20))
def test_skyline_is_brute_force(spark, points):
    rows = [(i, 0, a, b) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "i int, g int, a int, b int")
    got = {r.i for r in aggregates.skyline(df, ["g"], "a", "b").collect()}
    beats = lambda x, y: x[2] >= y[2] and x[3] >= y[3] and (x[2] > y[2] or x[3] > y[3])
    assert got == {y[0] for y in rows if not any(beats(x, y) for x in rows)}


def test_trajectory_ends_at_the_first_gap(spark):
    df = spark.createDataFrame([("k", 1, 2.0), ("k", 2, -5.0), ("k", 3, None), ("k", 4, 1.0)], "k string, i int, p double")
    out = sequences.ordered_trajectory(df, ["k"], ["i"], "p", F.lit(2.0), F.col("i") == 4)
    got = [(r.energy_status, r.cumulative_energy_wh) for r in out.orderBy("i").collect()]
    assert got == [("resolved", 4.0), ("resolved", -6.0), ("unresolved", None), ("failed", None)]
    s = one(sequences.trajectory_summary(out, ["k"]))
    assert s.severity == "FAIL" and s.ending_wh is None
    s = one(sequences.trajectory_summary(out.where("i < 3"), ["k"]))
    assert (s.severity, s.ending_wh, s.max_deficit_wh, s.max_surplus_wh) == ("PASS", -6.0, 6.0, 4.0)


def test_stored_energy_is_the_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, i // 7, i, None if k > 3 and rng.random() < 0.03 else rng.uniform(-40, 40), k == 5 and i == 20) for k in range(8) for i in range(60)]
    rows += [(8, 0, 0, None, False), (8, 0, 1, 5.0, False)]
    df = spark.createDataFrame(rows, "k int, b int, i int, e double, f boolean")
    got = {r.k: r for r in sequences.stored_energy(df, ["k"], "b", ["i"], "e", 50.0, 20.0, 90.0, F.col("f")).collect()}
    assert len(got) == 9
    for k in range(9):
        x, low, high, cut, unmet, known, failed, open_ = 50.0, 50.0, 50.0, 0.0, 0.0, True, 0, 0
        for _, _, _, e, f in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            failed, open_ = failed + f, open_ + (e is None and not f)
            known = known and not f and e is not None
            if known:
                cut, unmet = cut + max(0, x + e - 90), unmet + max(0, 20 - x - e)
                x = min(90.0, max(20.0, x + e))
                low, high = min(low, x), max(high, x)
        r = got[k]
        assert (r.curtailed_wh, r.unmet_wh) == pytest.approx((cut, unmet)) and (r.failed, r.unresolved) == (failed, open_)
        if known:
            assert (r.stored_wh, r.least_wh, r.most_wh) == pytest.approx((x, low, high))
        else:
            assert (r.stored_wh, r.least_wh, r.most_wh) == (None, None, None)
        assert r.severity == ("FAIL" if failed or unmet > 1e-9 else "CONDITIONAL" if open_ else "PASS")


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("x"), "id").repartition(5)
    got = [r.n for r in sequences.numbered(df, ["x", "id"], "n").orderBy("x", "id").collect()]
    assert got == list(range(1000))
    assert sequences.numbered(df.where("false"), ["x"], "n").count() == 0


def test_carried_forward_crosses_buckets(spark):
    rows = [("k", 0, 1, None), ("k", 0, 2, "a"), ("k", 1, 3, None), ("k", 3, 4, None), ("k", 3, 5, "b"), ("k", 4, 6, None)]
    df = spark.createDataFrame(rows, "k string, b int, i int, v string")
    out = sequences.carried_forward(df, ["k"], F.col("b"), ["i"], "v", "o").orderBy("i").collect()
    assert [r.o for r in out] == [None, "a", "a", "a", "b", "b"]


def test_soc_of_a_flat_window_and_outside(spark):
    df = spark.createDataFrame([(5.0, 5.0, 5.0), (1.0, 5.0, 9.0), (7.0, 5.0, 9.0)], "x double, lo double, hi double")
    out = bt.soc_observation(df, F.col("x"), F.col("lo"), F.col("hi"), F.lit(50.0)).collect()
    assert [(r.severity, r.soc_percent, r.reserve_state) for r in out] == [("CONDITIONAL", None, None), ("FAIL", None, None), ("PASS", 50.0, "at-reserve")]


def test_recharge_cases(spark):
    df = spark.createDataFrame([(0.0, 0.0, None), (1.0, 0.0, 5.0), (6.0, 2.0, None), (6.0, 2.0, 3.0), (6.0, 2.0, 2.0)], "n double, h double, a double")
    out = bt.recharge_window(df, F.col("n"), F.col("h"), F.col("a")).collect()
    assert [r.severity for r in out] == ["PASS", "FAIL", "CONDITIONAL", "PASS", "FAIL"]


def test_charger_output(spark):
    df = spark.createDataFrame([(100.0, 80.0, 50.0, 0.9), (100.0, None, None, None), (-1.0, None, None, None)], "r double, l double, i double, e double")
    out = [r[0] for r in df.select(bt.charger_output(*map(F.col, "rlie"))).collect()]
    assert out == [45.0, 100.0, 0.0]


def test_battery_side_power(spark):
    rows = [("ac", 10.0, 0.5, None, None, 12.0), ("ac", 10.0, None, None, None, 12.0), ("dc", 10.0, None, None, 24.0, 12.0), (None, 10.0, None, 0.8, 24.0, 12.0), (None, 10.0, None, None, None, 12.0)]
    df = spark.createDataFrame(rows, "s string, p double, i double, c double, l double, b double")
    assert [r[0] for r in df.select(el.battery_side_power(*map(F.col, "spiclb"))).collect()] == [20.0, None, None, 12.5, 10.0]


def test_exactly_one_abstains(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    got = {r.k: (r.matches, r.v) for r in joins.exactly_one(left, right, ["k"], "v").collect()}
    assert got == {1: (1, "a"), 2: (2, None), 3: (0, None)}


def test_bounded_product_rejects(spark):
    a, b = spark.range(10).toDF("a"), spark.range(11).toDF("b")
    with pytest.raises(ValueError, match="110"):
        joins.bounded_product([a, b], 109)
    assert joins.bounded_product([a, b], 110).count() == 110


def test_fronts_and_cycles(spark):
    options = spark.createDataFrame([(1, 5, 1.0), (2, 4, 1.0), (3, 5, None), (4, 3, 9.0)], "i int, x int, y double").withColumn("g", F.lit(0))
    pairs = selection.tiered_pairs(options, ["g"], "i", [[("x", True)], [("y", False)]])
    got = {(r.a, r.b): (r.relation, r.decisive_tier) for r in pairs.collect()}
    assert got[1, 2] == ("preferred", 0) and got[1, 3] == ("incomparable", 1) and got[2, 4] == ("preferred", 0)
    assert dict(selection.preference_fronts(options, pairs, "i").collect()) == {1: 0, 3: 0, 2: 1, 4: 2}
    ring = spark.createDataFrame([(1, 2, "preferred"), (2, 4, "preferred"), (1, 4, "worse")], "a int, b int, relation string")
    with pytest.raises(ValueError, match="cycle"):
        selection.preference_fronts(options.where("i <> 3"), ring, "i")


def test_optional_capability_states(spark):
    rows = [(1, "known", True), (1, "unknown", None), (2, "absent", None), (2, "known", False), (3, "not_applicable", None), (4, "absent", None), (4, "unknown", None)]
    df = spark.createDataFrame(rows, "k int, s string, v boolean")
    assert dict(selection.optional_capability(df, ["k"], "s", "v").collect()) == {1: "present", 2: "absent", 3: "not_applicable", 4: "unknown"}


def test_envelope_with_an_unknown_clearance(spark):
    df = spark.range(1)
    size = tuple(F.lit(v) for v in (1.0, 2.0, 3.0))
    axes = F.array(F.lit(2), F.lit(0), F.lit(1))
    known = F.array(F.array(*[F.lit(1.0)] * 6), F.array(*[F.lit(0.5)] * 6))
    r = one(selection.installation_envelope(df, size, axes, known))
    assert (r.need_x, r.need_y, r.need_z) == (4.0, 5.0, 3.0)
    holed = F.array(F.array(*[F.lit(1.0)] * 5, F.lit(None).cast("double")))
    assert one(selection.installation_envelope(df, size, axes, holed)).status == "unresolved"


def test_assessment_caps_weak_evidence(spark):
    adv = spark.createDataFrame([(1, ["e1"], "exclude"), (2, ["e2", "e1"], "exclude"), (3, ["e3"], "exclude")], "id int, evidence_ids array<string>, policy_action string")
    ev = spark.createDataFrame(
        [("e1", "forum_report", "active", "verified", "s1"), ("e2", "recall", "active", "verified", "s2"), ("e3", "recall", "closed", "verified", "s2")],
        "id string, type string, status string, verification_status string, source_key string",
    )
    got = {r.id: (r.assessed_action, r.assessed_confidence) for r in advisories.assess(adv, ev).collect()}
    assert got == {1: ("caution", "low"), 2: ("exclude", "high"), 3: ("none", "low")}


def test_catalog_ranks(spark):
    c = spark.createDataFrame([(i,) for i in range(5)], "id int")
    cat = spark.createDataFrame([(0, "stocked", "preferred"), (1, "special_order", None), (2, "unknown", None), (3, "stocked", "discouraged")], "id int, availability string, preference string")
    got = {r.id: (r.status, r.rank) for r in advisories.catalog_overlay(c, cat, "id").collect()}
    assert got == {0: ("eligible", 0), 1: ("eligible", 3), 2: ("unknown", 999), 3: ("eligible", 5), 4: ("ineligible", 999)}


def test_cycles_and_long_chains(spark):
    rows = [(i, i - 1 if i else None) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (203, 202), (300, 300)]
    df = spark.createDataFrame(rows, "n int, p int")
    got = {r.n for r in links.cyclic_nodes(df, "n", "p").collect() if r.cyclic}
    assert got == {200, 201, 202, 203, 300}


def test_quantities(spark):
    rows = [("1,200 mW", None), (".5 kV", "kv"), ("5 W", "A"), ("5", "ft"), ("5", None), ("about 5", "W"), ("5 parsec", None), (None, "W"), ("", None)]
    df = spark.createDataFrame(rows, "raw string, unit string")
    got = [(r.code, r.canonical) for r in facts.normalised_units(df.coalesce(1), F.col("raw"), F.col("unit")).collect()]
    assert sorted(map(str, got)) == sorted(
        map(str, [("normalized", 1.2), ("normalized", 500.0), ("contradictory_unit", None), ("normalized", 1524.0), ("missing_unit", None),
                  ("ambiguous_value", None), ("unsupported_unit", None), ("ambiguous_value", None), ("ambiguous_value", None)])
    )


def test_units_of_all_dimensions_and_gauges(spark):
    want = {
        ("30 psi", None): 206.842719, ("2 bar", None): 200.0, ("10 Nm", None): 10.0, ("12 ft-lbs", None): 16.269815, ("1 us gal", None): 3.785412, ("90 L/h", None): 1.5,
        ("5", "us gpm"): 18.927059, ("12 V nominal", "v"): 12.0, ("3 mΩ", None): 0.003, ("6\"", None): 152.4, ("2'", "ft"): 609.6, ("300 K", None): 26.85, ("16 mm²", None): 16.0,
        ("10 AWG", None): 5.261, ("2/0", "awg"): 67.431, ("10 awg", "mm2"): None, ("12 AWG wire", None): None, ("5 AWG", "AWG"): 16.773,
    }
    df = spark.createDataFrame(list(want), "raw string, unit string")
    got = {(r.raw, r.unit): r.canonical for r in facts.normalised_units(df, F.col("raw"), F.col("unit")).collect()}
    assert got == {k: v if v is None else pytest.approx(v, rel=1e-4) for k, v in want.items()}
    names = [u[0] for u in tx.UNITS]
    assert len(names) == len(set(names)) and tx.unit_table(spark).count() == len(names)


def test_read_only_urls(spark):
    yes = ["https://a.b/index.php", "https://a.b/charge-controller?x=cart", "https://a.b/a+b/%C3%A9", "HTTPS://a.b", "https://a.b?do=export__csv", "https://a.b#cart"]
    no = ["https://a.b/%43art", "https://a.b/x/Add_To_Cart", "https://a.b?ACTION=Remove-Cart", "https://a.b?do=index", "https://a.b/%", "no url", "/cart", "https://a.b?x=1&message", "https://a.b/save.asp"]
    df = spark.createDataFrame([(u, True) for u in yes] + [(u, False) for u in no] + [(None, None)], "u string, want boolean")
    assert [(r.u, r.got) for r in df.select("u", tx.read_only_url(F.col("u")).alias("got")).collect()] == [(r.u, r.want) for r in df.collect()]


def test_capture_priorities(spark):
    rows = [
        ("https://a.b/x.mp4", "manual", None, 1, False, "generic", 3, 6),
        ("https://a.b/docs/", "HTML5", None, 0, True, "manual_index", 1, 0),
        ("https://a.b/index", "x", None, 0, True, "manual_index", 1, 0),
        ("https://a.b/index.pdf", "x", None, 0, True, "manual", 1, 2),
        ("https://a.b/Manuals", "x", None, 0, False, "support_product", 2, 5),
        ("https://a.b/x", "user guide", "support_article", 0, False, "support_product", 2, 5),
        ("https://a.b/x.html", "dimensiondrawing", None, 0, False, "technical_drawing", 1, 3),
        ("https://a.b/specific", "data sheet", None, 0, False, "datasheet", 1, 1),
        ("https://a.b/x", None, "product_page", None, None, "support_product", 2, 5),
        ("https://a.b/x", "news", None, None, None, "generic", 3, 6),
    ]
    df = spark.createDataFrame(rows, "u string, l string, r string, d int, m boolean, c string, t int, p int")
    out = facts.capture_priority(df, F.col("u"), F.col("l"), F.lit(False), F.col("r"), F.col("d"), F.lit(1), F.col("m"))
    assert [(r.category, r.tier, r.priority) for r in out.collect()] == [r[5:] for r in rows]


def test_html_limits_are_marked():
    page = "<p>abcdef</p><table><tr><td>a<td>b<tr><td>c<td>d</table><p>x</p>"
    whole = html.blocks_of(page)
    assert [b["truncated"] for b in whole] == [False] * 3 and whole[1]["n_cells"] == 4 and len(whole[1]["rows"]) == 2
    cut = html.blocks_of(page, (2, 3, 4))
    assert [(b["text"], b["truncated"], b["n_cells"], len(b["rows"])) for b in cut] == [("abcd", True, 0, 0), ("abcd", True, 2, 1)]
    assert html.blocks_of("<p>a</p>" * 20_000)[-1]["truncated"] is False and len(html.blocks_of("<p>a</p>" * 20_000)) == 20_000


def test_long_fronts_over_many_groups(spark):
    rows = [(g * 1000 + i, g, i) for g in range(3) for i in range(12)] + [(9000 + i, 9, 0) for i in range(200)]
    options = spark.createDataFrame(rows, "i int, g int, x int")
    got = dict(selection.preference_fronts(options, selection.tiered_pairs(options, ["g"], "i", [[("x", True)]]), "i").collect())
    assert got == {i: 0 if g == 9 else 11 - x for i, g, x in rows}


def test_gauges_slugs_and_fingerprints(spark):
    df = spark.createDataFrame([("4/0 AWG", "Foo & Bar--9"), ("000", ""), ("14awg", "é"), ("x", "-a-")], "g string, s string")
    got = df.select(tx.awg_index(F.col("g")), tx.slug(F.col("s")), tx.fnv1a(F.col("s"))).collect()
    assert [r[0] for r in got] == [-3, -2, 14, None]
    assert [r[1] for r in got] == ["foo-bar-9", "", "", "a"]
    assert got[1][2] == 2166136261


def test_reconciled_groups(spark):
    rows = [(1, 5.0, "A", True), (2, 5.0, "A", False), (3, 5.0, "A", True), (3, 5.0, "A", True), (4, 5.0, "A", True), (4, 6.0, "A", True), (5, 5.0, "A", True), (5, 5.0, "V", True), (6, None, "A", True), (6, 5.0, "A", True)]
    df = spark.createDataFrame(rows, "k int, v double, u string, s boolean")
    got = {r.k: r.outcome for r in facts.reconcile_groups(df, ["k"], "v", "u", F.col("s")).collect()}
    assert got == {1: "single_observation", 2: "unresolved", 3: "agreement", 4: "conflict", 5: "unresolved", 6: "unresolved"}


def test_html_blocks_of_nested_and_broken_pages(spark):
    page = (
        "<h1>A &amp; B</h1><script>no()</script><p>one<br>two<p>three<table><tr><th>k<td>v<td>w<tr><td>x</table>"
        "<dl><dt>t<dd>d</dl><ul><li>i<li>j <b>k</b></ul><figcaption>f"
    )
    got = [(b["kind"], b["text"], b["section"]) for b in html.blocks_of(page)]
    assert got == [
        ("heading", "A & B", "A & B"), ("paragraph", "one two", "A & B"), ("paragraph", "three", "A & B"), ("table", "kvwx", "A & B"),
        ("definition", "t: d", "A & B"), ("list", "i j k", "A & B"), ("figure_caption", "f", "A & B"),
    ]
    assert html.blocks_of(page)[3]["rows"] == [{"label": "k", "value": "v w", "row": 1}, {"label": "x", "value": "x", "row": 2}]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x")], "page_id long, html string")
    assert [(r.page_id, r.seq, r.text) for r in html.html_blocks(df).collect()] == [(3, 0, "x")]


def test_content_store_and_create_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, c string")
    path = str(tmp_path / "store")
    storage.put_content(df, "c", path)
    keyed = storage.put_content(df, "c", path)
    assert spark.read.parquet(path).count() == 2
    got = storage.get_content(keyed.select("i", "digest"), path).orderBy("i").collect()
    assert [(r.content, r.intact) for r in got] == [("a", True), ("a", True), ("b", True), (None, None)]
    with pytest.raises(ValueError):
        storage.create_only(df, ["c"], str(tmp_path / "new"))
    storage.create_only(df, ["i"], str(tmp_path / "new"))
    with pytest.raises(Exception, match="(?i)already"):
        storage.create_only(df, ["i"], str(tmp_path / "new"))


def test_corrupt_json_is_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": "x"}\n')
    got = tables.read_json_records(spark, str(tmp_path / "a.json"), "id int", whole_file=False).orderBy("id").collect()
    assert [(r.id, r._corrupt_record is None) for r in got] == [(None, False), (1, True)]
