"""Schema documents, decision histories, derived facts, versioned logs and guarded replacement against plain expectations."""

import json
import random

import pytest
from compare import shuffled_rows
from pyspark.sql import functions as F

from plumbline.operators import histories
from plumbline.sources import schemas, storage
from plumbline.streaming import state

NODE = {
    "type": "object",
    "properties": {
        "a": {"type": ["integer", "null"]},
        "b": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string", "minLength": 2}}}, "minItems": 1},
        "c": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]},
        "d": {"const": [1, {"k": "v"}]},
        "e": {"format": "date"},
        "f/g~h": {"type": "boolean"},
        "i": {"$ref": "shared#/$defs/code"},
        "j": {"uniqueItems": True, "items": {"items": {"maximum": 3}}},
        "k": {"allOf": [{"exclusiveMaximum": 2}, {"not": {"const": 0}}]},
        "l": {"propertyNames": {"pattern": "^[a-z]+$"}, "additionalProperties": {"type": "number"}, "maxProperties": 2},
        "m": False,
    },
    "dependentRequired": {"a": ["b"]},
}
SHARED = {"$id": "shared", "$defs": {"code": {"$ref": "#/$defs/short"}, "short": {"enum": ["p", 7, True, None]}}}

CASES = [
    ({}, []),
    ([], [":type"]),
    ({"a": 1, "b": [{"x": "yes"}]}, []),
    ({"a": 1.0, "b": [{"x": "yes"}]}, []),
    ({"a": 1.5, "b": [{"x": "yes"}]}, ["/a:type"]),
    ({"a": None}, ["/b:dependentRequired"]),
    ({"b": []}, ["/b:minItems"]),
    ({"b": [{"x": "no"}, {"x": "n"}, {}, {"x": 4}, 5]}, ["/b/1/x:minLength", "/b/2/x:required", "/b/3/x:type", "/b/4:type"]),
    ({"c": 3}, []),
    ({"c": 7}, ["/c:oneOf"]),
    ({"c": 2.5}, ["/c:oneOf"]),
    ({"d": [1, {"k": "v"}]}, []),
    ({"d": [1, {"k": "w"}]}, ["/d:const"]),
    ({"e": "2024-02-30"}, []),
    ({"e": "2024-13-01"}, ["/e:format"]),
    ({"e": 5}, []),
    ({"f/g~h": "x"}, ["/f~1g~0h:type"]),
    ({"i": 7.0}, []),
    ({"i": "7"}, ["/i:enum"]),
    ({"i": None}, []),
    ({"i": 1}, ["/i:enum"]),
    ({"j": [[1, 4], [5]]}, ["/j/0/1:maximum", "/j/1/0:maximum"]),
    ({"j": [{"p": 1, "q": 2}, {"q": 2, "p": 1}]}, ["/j:uniqueItems"]),
    ({"k": 2}, ["/k:exclusiveMaximum"]),
    ({"k": 0}, ["/k:not"]),
    ({"k": "text"}, []),
    ({"l": {"ab": 1, "A/b": "x"}}, ["/l/A~1b:pattern", "/l/A~1b:type"]),
    ({"l": {"a": 1, "b": 2, "c": 3}}, ["/l:maxProperties"]),
    ({"m": 1}, ["/m:false"]),
    ({"unknown": {"deep": [1]}}, []),
]


def test_schema_issues_of_every_keyword(spark):
    texts = [(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)]
    odd = [(100, None), (101, ""), (102, "{"), (103, '{"a":1,"a":1}'), (104, "null"), (105, '{"b":[' + '{"x":"yy"},' * 20000 + '{"x":"z"}]}')]
    df = spark.createDataFrame(texts + odd, "id long, text string")
    found = df.select("id", schemas.schema_issues(F.col("text"), NODE, {"shared": SHARED}).alias("i")).collect()
    got = {r.id: [f"{x.path}:{x.keyword}" for x in r.i] for r in found}
    assert {i: got[i] for i, _ in texts} == {i: sorted(want) for i, (_, want) in enumerate(CASES)}
    assert [got[i] for i in range(100, 106)] == [[":json"]] * 4 + [[":type"], ["/b/20000/x:minLength"]]
    rows = schemas.violations(df.withColumn("path", F.lit("?")), "text", NODE, {"shared": SHARED})
    assert rows.columns == ["id", "path", "keyword"] and rows.count() == sum(map(len, got.values()))
    assert df.where("id < 0").select(schemas.schema_issues(F.col("text"), NODE, {"shared": SHARED})).count() == 0


@pytest.mark.parametrize("schema", [{"typ": "object"}, {"format": "colour"}, {"items": {"$ref": "#"}}, {"$ref": "other#"}, {"properties": {"a": {"unevaluatedItems": False}}}])
def test_schemas_that_cannot_be_checked_are_errors(spark, schema):
    with pytest.raises(ValueError):
        schemas.schema_issues(F.col("text"), schema)


DECISION = "id long, proposal long, revision long, previous long, previous_digest string, digest string, proposal_digest string, snapshot string, outcome string, value long"


def test_replay_keeps_stale_and_broken_decisions_inert(spark):
    proposals = [(p, "now", "s1", 10 + p) for p in (1, 2, 3, 4, 5, 6, 7)] + [(None, "now", "s1", 0)]
    step = lambda i, p, r, before, outcome="map", digest="now", snapshot="s1": (
        i, p, r, before, f"d{before}" if before else None, f"d{i}", digest, snapshot, outcome, 100 + i,
    )
    decisions = [
        step(20, 2, 1, None, "reject"), step(21, 2, 2, 20),  # chain, mapped
        step(30, 3, 1, None), step(31, 3, 3, 30),  # gap
        step(40, 4, 1, None), step(41, 4, 2, 40, snapshot="s0"),  # last one stale
        step(50, 5, 1, None, digest="then"), step(51, 5, 2, 50, "defer"),  # only the first is stale
        step(60, 6, 1, None), step(61, 6, 1, None),  # revision twice
        step(70, 7, 1, None), step(71, 7, 2, 99),  # foreign link
        step(80, 8, 1, None), step(81, 8, 2, 80),  # no such proposal
        step(90, None, 1, None), step(91, 1, None, None),  # not seen
    ]
    p = spark.createDataFrame(proposals, "proposal long, digest string, snapshot string, value long")
    d = spark.createDataFrame(decisions, DECISION)
    replayed = histories.replayed_decisions(p, d)
    got = {r.proposal: (r.state, r.decision, r.decisions, r.inert, r.effective) for r in replayed.collect() if r.proposal}
    assert got == {
        1: ("automatic", None, 0, 0, 11), 2: ("map", 21, 2, 1, 121), 3: ("broken", 31, 2, 2, None), 4: ("stale", 41, 2, 2, 14),
        5: ("defer", 51, 2, 1, None), 6: ("broken", 60, 2, 2, None), 7: ("broken", 71, 2, 2, None), 8: ("stale", 81, 2, 2, None),
    }
    events = {r.id: r.event for r in histories.decision_events(replayed, d).collect()}
    assert [events[i] for i in (20, 21, 40, 41, 50, 51, 80, 61)] == ["superseded", "active", "stale", "stale", "superseded", "active", "stale", "broken"]
    assert events[90] is None


def test_decisions_that_are_together_stay_where_they_are(spark):
    n, width = 20_000, 5
    k, place = F.col("id"), F.col("id") % width
    decisions = spark.range(n).repartition(4).select(
        k, (k / width).cast("long").alias("proposal"), (place + 1).alias("revision"), F.when(place > 0, k - 1).alias("previous"),
        F.when(place > 0, F.concat(F.lit("d"), k - 1)).alias("previous_digest"), F.concat(F.lit("d"), k).alias("digest"), F.lit("now").alias("proposal_digest"),
        F.lit("s").alias("snapshot"), F.lit("map").alias("outcome"), k.alias("value"),
    )
    proposals = decisions.where("revision = 1").select("proposal", F.col("proposal_digest").alias("digest"), "snapshot", F.lit(0).cast("long").alias("value"))
    given = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for c in given:
        spark.conf.set(c, "-1")
    stored = {"p": storage.cut(proposals), "d": storage.cut(decisions)}
    before = shuffled_rows(spark)
    got = histories.replayed_decisions(stored["p"], stored["d"].repartition("proposal")).groupBy("state", "decisions", "inert", F.col("effective") % width).count().collect()
    moved = shuffled_rows(spark) - before
    for c, v in given.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert [tuple(r) for r in got] == [("map", width, width - 1, width - 1, n // width)]
    # all decisions once, all proposals once and a few sums
    assert moved < 1.5 * n


def test_one_proposal_with_most_decisions(spark):
    many = spark.range(1, 50_001).select(
        F.col("id"), F.lit(1).cast("long").alias("proposal"), F.col("id").alias("revision"), F.when(F.col("id") > 1, F.col("id") - 1).alias("previous"),
        F.when(F.col("id") > 1, F.concat(F.lit("d"), F.col("id") - 1)).alias("previous_digest"), F.concat(F.lit("d"), "id").alias("digest"), F.lit("now").alias("proposal_digest"),
        F.lit("s").alias("snapshot"), F.lit("map").alias("outcome"), F.col("id").alias("value"),
    )
    p = spark.createDataFrame([(1, "now", "s", 0)], "proposal long, digest string, snapshot string, value long")
    assert tuple(histories.replayed_decisions(p, many).first()) == (1, "map", 50_000, 50_000, 49_999, 50_000)
    assert histories.replayed_decisions(p, many.limit(0)).first().state == "automatic"


def test_derived_facts_need_one_known_fact_of_each_input(spark):
    capacity, share, own = "nominal_capacity_ah", "usable_fraction", "usable_capacity_ah"
    facts = [
        (1, capacity, 100.0, 1), (1, share, 0.5, 2), (1, "other", 3.0, 9),
        (2, capacity, 100.0, 3), (2, share, 0.5, 4), (2, own, 50.0, 5),
        (3, capacity, 100.0, 6), (3, share, 0.5, 7), (3, own, 50.0, 8), (3, own, 50.0, 9),
        (4, capacity, 100.0, 1), (4, capacity, 100.0, 2), (4, share, 0.5, 3),
        (5, capacity, None, 1), (5, share, 0.5, 2),
        (6, capacity, 100.0, 1), (6, share, 1.5, 2),
        (7, capacity, 100.0, 1), (7, share, 0.5, 2), (7, own, None, 3),
        (8, "nominal_voltage_v", 12.0, 1), (8, "series_voltage_v", 48.0, 2), (9, "nominal_voltage_v", 12.0, 1), (9, "series_voltage_v", 50.0, 2),
    ]
    df = spark.createDataFrame(facts, "product long, target string, value double, id long")
    got = {r["product"]: (r.target, r.value, r.disposition, r.inputs, r.direct) for r in histories.derived_facts(df, histories.BATTERY, "product", "target", "value", "id").collect()}
    assert got == {
        1: (own, 50.0, "mapped", [1, 2], 0), 2: (own, 50.0, "evidence_only", [3, 4], 1), 3: (own, 50.0, "conflicting", [6, 7], 2),
        7: (own, 50.0, "conflicting", [1, 2], 1), 8: ("series_count", 4.0, "mapped", [1, 2], 0),
    }


STEPS = {"": ("a",), "a": ("a", "b"), "b": ("a",)}


def _plain(rows):
    current, now, version, out = {}, {}, {}, {}
    for k, at, i, expected, to in sorted(rows, key=lambda r: r[:2]):
        if current.get(k) != expected:
            out[i] = ("conflict", None)
        elif to not in STEPS.get(now.get(k, ""), ()):
            out[i] = ("illegal", None)
        else:
            current[k], now[k], version[k] = i, to, version.get(k, 0) + 1
            out[i] = ("accepted", version[k])
    return out


def _writes(seed, keys, n):
    draw, rows, good = random.Random(seed), [], {}
    for i in range(n):
        k = 0 if draw.random() < 0.5 else draw.randrange(keys)
        seen = [r[2] for r in rows if r[0] == k][-6:]
        expected = good.get(k) if draw.random() < 0.8 else draw.choice([None, *seen, n - 1 - i, 10**7])
        rows.append((k, i, i, expected, draw.choice("aaabc")))
        if _plain(r for r in rows if r[0] == k)[i][0] == "accepted":
            good[k] = i
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_versioned_log_is_the_plain_loop(spark, seed):
    rows = _writes(seed, 5, 300)
    df = spark.createDataFrame(rows, "k long, at long, i long, expected long, to string")
    got = histories.versioned_log(df.repartition(5), "k", ["at"], "i", "expected", "to", STEPS).collect()
    want = _plain(rows)
    assert {r.i: (r.outcome, r.version) for r in got} == want and len(got) == len(rows)
    assert {o for o, _ in want.values()} == {"accepted", "illegal", "conflict"} and max(v or 0 for _, v in want.values()) > 30
    empty = histories.versioned_log(df.where("k < 0"), "k", ["at"], "i", "expected", "to", STEPS)
    assert empty.count() == 0 and empty.columns == [*df.columns, "outcome", "version"]


def test_versioned_log_of_one_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(histories, "cut", lambda df: (rounds.append(1), storage.cut(df))[1])
    chain = spark.range(20_000).select(F.lit(1).alias("k"), "id", (F.col("id") - 1).alias("expected"), F.lit("a").alias("to"))
    log = chain.withColumn("expected", F.when(F.col("id") > 0, F.col("expected")))
    got = histories.versioned_log(log, "k", ["id"], "id", "expected", "to", STEPS)
    assert got.where("version = id + 1").count() == 20_000
    assert len(rounds) <= 3 + 16


def test_versioned_log_as_a_stream_is_the_batch(spark, tmp_path):
    rows = _writes(3, 4, 240)
    for b in range(3):
        part = spark.createDataFrame(rows[80 * b : 80 * b + 80], "k long, at long, i long, expected long, to string").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "log"))
    source = spark.readStream.schema("k long, at long, i long, expected long, to string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = state.versioned_log_stream(source, "k", ["at"], "i", "expected", "to", STEPS)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    got = {r.i: (r.outcome, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == _plain(rows)


def _files(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_partitions_are_replaced_only_if_nobody_wrote_in_between(spark, tmp_path):
    path = tmp_path / "table"
    rows = spark.range(30).select("id", (F.col("id") % 3).alias("p"), F.lit("old").alias("v"))
    rows.write.partitionBy("p").parquet(str(path))
    seen = storage.cut(storage.partition_snapshots(spark.read.parquet(str(path)), ["p"]))
    before = _files(path)
    new = rows.where("p = 1").withColumn("v", F.lit("new"))
    storage.replace_partitions(new, ["p"], seen, str(path))
    after = _files(path)
    assert {f: t for f, t in before.items() if "p=1" not in str(f)} == {f: t for f, t in after.items() if "p=1" not in str(f)}
    table = spark.read.parquet(str(path))
    assert table.count() == 30 and {(r.p, r.v) for r in table.distinct().collect()} == {(0, "old"), (1, "new"), (2, "old")}
    with pytest.raises(ValueError):  # `seen` is of the table before
        storage.replace_partitions(rows.where("p > 0"), ["p"], seen, str(path))
    with pytest.raises(ValueError):  # a partition that was there is not expected to be
        storage.replace_partitions(rows.where("p = 2"), ["p"], seen.where("p = 0"), str(path))
    assert _files(path) == after
    storage.replace_partitions(rows.where("p = 2").withColumn("p", F.lit(7).cast("long")), ["p"], seen, str(path))
    assert spark.read.parquet(str(path)).count() == 40
