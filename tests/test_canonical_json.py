"""Canonical JSON against a plain recursive writer."""

import json
import random
import time

from pyspark.sql import functions as F

from plumbline.functions import text as tx


def number(x):
    """A double as most readers print it."""
    mantissa, _, power = repr(abs(float(x))).partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits, at = (whole + fraction).lstrip("0"), len(whole) + int(power or 0) - (len(whole + fraction) - len((whole + fraction).lstrip("0")))
    digits = digits.rstrip("0")
    if not digits:
        return "0"
    if at > 21 or at < -5:
        out = digits[0] + ("." + digits[1:] if digits[1:] else "") + ("e+" if at > 0 else "e") + str(at - 1)
    elif at <= 0:
        out = "0." + "0" * -at + digits
    else:
        out = digits[:at].ljust(at, "0") + ("." + digits[at:] if digits[at:] else "")
    return ("-" if x < 0 else "") + out


def plain(value):
    if isinstance(value, dict):
        inner = (f"{json.dumps(k, ensure_ascii=False)}:{plain(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be")))
        return "{" + ",".join(inner) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain, value)) + "]"
    return number(value) if type(value) in (int, float) else json.dumps(value, ensure_ascii=False)


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 4 else 4)
    if kind > 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))] if kind == 5 else {
            rng.choice(["a", "b", "Z", "é", "😀", "￮", 'q"', "\\", "1", "a1.0"]): value(rng, depth + 1) for _ in range(rng.randint(0, 5))
        }
    return rng.choice([
        None, True, False, "", 'say "1.50" \\ 2e3', "tab\there", rng.randint(-(10**6), 10**6), rng.randint(0, 2**60), rng.uniform(-1, 1), rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 25),
        0.1, 1e21, 1e20, 1e-6, 1e-7, 123456789.5, -0.0, 5e-7, 10.0**15,
    ])


def shuffled(v, rng):
    if isinstance(v, dict):
        items = [(k, shuffled(x, rng)) for k, x in v.items()]
        rng.shuffle(items)
        return dict(items)
    return [shuffled(x, rng) for x in v] if isinstance(v, list) else v


def test_equal_values_have_one_text(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(600):
        v = value(rng)
        want[i] = plain(v)
        rows += [(i, json.dumps(v)), (i, json.dumps(shuffled(v, rng), ensure_ascii=False, indent=1))]
    df = spark.createDataFrame(rows, "id int, x string")
    for r in df.select("id", tx.canonical_json(F.col("x")).alias("c")).collect():
        assert r.c == want[r.id]


def test_what_is_not_portable_has_no_text(spark):
    deep = "[" * 1200 + "]" * 1200
    bad = [None, "", "{", '{"a":1,"a":1}', "1e400", "[-1e999]", "9" * 400, "NaN", "[1,]", deep, "{'a':1}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "id int, x string")
    assert {r.c for r in df.select(tx.canonical_json(F.col("x")).alias("c")).collect()} == {None}
    good = [('"1e400"', '"1e400"'), (" 1.0e0 ", "1"), ("[" * 900 + "]" * 900, "[" * 900 + "]" * 900), ('"' + "\\n" * 50_000 + '"', '"' + "\\n" * 50_000 + '"')]
    df = spark.createDataFrame([(x, y) for x, y in good], "x string, y string")
    assert [r.c == r.y for r in df.select(tx.canonical_json(F.col("x")).alias("c"), "y").collect()] == [True] * 4


def test_texts_between_numbers_cost_no_exceptions(spark):
    """Was 27 s for 10,000 such rows on one core, most of it exceptions of casts of what is no number."""
    text = F.concat(F.lit('{"z":[{"b":'), F.col("id") / 7, F.lit(',"a":"x 1.0"},[],{},null,'), F.col("id"), F.lit('.50E+2],"p":{"k":3},"a":{"y":7e1,"x":8.00}}'))
    df = spark.range(0, 10_000, 1, 1).select(tx.canonical_json(text).alias("c"))
    df.limit(10).collect()
    began = time.perf_counter()
    assert df.where("c IS NULL").count() == 0
    assert time.perf_counter() - began < 15
    spelled = ["7.0", "-7.0", "0.0", "-0.0", "-0", "1234567.7654321", "-0.00001", "0.10", "999999999999999.0", "1000000000000000.0", "0.000001", "0.0000001", "123456789012345678"]
    rows = spark.createDataFrame([(s,) for s in spelled], "x string").select("x", tx.canonical_json(F.col("x")).alias("c")).collect()
    assert all(r.c == number(float(r.x)) for r in rows)


def test_one_row_group_is_many_tasks(spark, sf_dir):
    """A file of one row group was one task, whatever the checks of a row cost."""
    import __spark_entry__

    for name in ("nested_canonical", "schema_issues"):
        found = __spark_entry__.queries()[name](spark, sf_dir)
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
