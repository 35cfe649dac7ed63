import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import histogram_sharding as hs
from plumbline.llm import quality_rules as qr
from plumbline.llm import spotsigs


def test_shards_are_even_and_gapless(spark, sf_dir, texts):
    got = hs.op6_histogram_sharding(spark, sf_dir).collect()
    assert len(got) == len(texts)
    size, slots = Counter(), {}
    for r in got:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(40))
    largest = max(len(t.encode()) for t in texts.values()) + 16
    mean = sum(size.values()) / 40
    assert all(abs(s - mean) <= largest for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("slices", [1, 3])
def test_one_text_in_a_third_of_rows_is_split(spark, slices):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}" * (i % 9)) for i in range(3000)]
    got = hs.shard(spark.createDataFrame(rows, "doc_id long, text string"), 7, slices_per_shard=slices).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    hot = sorted({r.shard for r in got if r.text == "hot"})
    assert len(hot) > 1 and hot == list(range(hot[0], hot[-1] + 1))


def test_repeated_rows_are_split_like_others(spark):
    rows = [(7 if i % 3 else None, "the same row") for i in range(2400)] + [(i, f"text {i}") for i in range(600)]
    got = hs.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 3000 and max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tasks_grow_with_bytes_not_with_shards(spark, monkeypatch):
    cuts, plain = [], hs.cut
    monkeypatch.setattr(hs, "cut", lambda df: cuts.append(plain(df)) or cuts[-1])
    monkeypatch.setattr(hs, "TASK_BYTES", 4000)
    rows = [(i, "the same long row " * 5 if i % 2 else f"text {i} " * 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = hs.shard(df, 3)
    total = sum(r.size for r in got.collect())
    assert sorted((r.shard, r.slot) for r in got.collect()) == [
        (s, k) for s in range(3) for k in range(got.where(F.col("shard") == s).count())
    ]
    sizes = [r.n for r in cuts[1].groupBy("part").agg(F.sum("weight").alias("n")).collect()]
    assert len(sizes) >= 20 and max(sizes) <= 3 * hs.TASK_BYTES and sum(sizes) == total


def test_small_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 3}" * (i // 3 % 7 + 1)) for i in range(3000)]
    got = hs.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    shards_of = {}
    for r in got:
        shards_of.setdefault(r.text, set()).add(r.shard)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    mean, largest = sum(size.values()) / 5, max(r.size for r in got)
    assert sum(len(s) > 1 for s in shards_of.values()) <= 1
    assert all(abs(s - mean) <= 2 * max(0.005 * mean, largest) for s in size.values())


def test_splitters_are_those_of_a_full_sort(spark):
    rows = [(i * 7919 % 1009 - 500, i % 5, i % 3 - 1, i % 13 + 1) for i in range(2000)]
    keyed = spark.createDataFrame(rows, "key_text long, key_id long, key_row long, weight long")
    total = sum(w for *_, w in rows)
    targets = [total * k / 9 for k in range(1, 9)]

    def as_key(*parts):
        whole = 0
        for p in parts:
            whole = whole << 64 | (p + (1 << 63))
        return whole

    for target, s in zip(targets, hs.find_splitters(keyed, targets, 0.0), strict=True):
        below = sum(w for *key, w in rows if as_key(*key) < s)
        group = Counter()
        for *key, w in rows:
            group[as_key(*key)] += w
        assert abs(below - target) <= max(group.values()) / 2 + 1e-9


def test_sharding_odd_rows(odd, odd_rows, none):
    got = hs.shard(odd, 3).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t, _ in odd_rows)
    assert sorted((r.shard, r.slot) for r in got) == sorted(
        (s, k) for s, n in Counter(r.shard for r in got).items() for k in range(n)
    )
    assert hs.shard(none, 3).count() == 0


def measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_of_documents_and_odd_rows(spark, sf_dir, texts, odd, odd_rows, none):
    for r in qr.op8_quality_rules(spark, sf_dir).collect():
        want = measure(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    got = qr.apply_rules(odd)
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words) for r in got.collect()) == sorted(
        (str(i), measure(t or "")[0], measure(t or "")[4]) for i, t, _ in odd_rows
    )
    assert qr.apply_rules(none).count() == 0


def test_quality_rules_match_the_oracle(spark, duck, sf_dir):
    from compare import rows_of_duck, rows_of_spark

    assert rows_of_spark(qr.op8_quality_rules(spark, sf_dir)) == rows_of_duck(duck, qr.ORACLE_SQL)


def test_a_broken_rule_is_named(spark):
    df = spark.createDataFrame([("the a # $$ " * 40,), ("word " * 60,), ("x",)], "text string")
    assert [r.broken_rules for r in qr.apply_rules(df).collect()] == [
        ["repeats_words", "mean_word_length", "symbols"], ["repeats_words", "stop_words"], ["too_short", "mean_word_length", "stop_words"],
    ]


def signature_words(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    at = [i for i, w in enumerate(words) if w in spotsigs.ANCHORS] or range(len(words))
    out = set()
    for i in at:
        content = [w for w in words[i + 1 : i + 1 + spotsigs.REACH] if w not in spotsigs.ANCHORS]
        out.add((words[i], *content[: spotsigs.CHAIN]))
    return out


def test_signature_sets_are_the_plain_chains(spark, texts):
    some = [(i, t) for i, t in texts.items() if t.isascii()][:200] + [(-1, ""), (-2, "alone"), (-3, "the the of")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    # Spark's own hash of every plain chain
    chains = [(i, *(list(c) + [None] * (spotsigs.CHAIN + 1 - len(c)))) for i, t in some for c in signature_words(t)]
    hashed = spark.createDataFrame(chains, "doc_id long, a string, b string, c string").select("doc_id", F.hash("a", "b", "c").alias("h"))
    want = {r.doc_id: sorted(r.hs) for r in hashed.groupBy("doc_id").agg(F.collect_set("h").alias("hs")).collect()}
    assert got == {i: want.get(i, []) for i, _ in some}


def test_edited_texts_and_neighbours(spark, sf_dir, texts):
    got = {r.doc_id: r for r in spotsigs.op3_spotsigs(spark, sf_dir).collect()}
    ids = sorted(texts)
    sets = {i: set(r.fingerprint.split(":")[1].split(",")) - {""} for i, r in got.items()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, i in enumerate(ids):
        after, r = ids[(k + 1) % len(ids)], got[i]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == pytest.approx(jaccard(sets[i], sets[after]))
        assert r.near_edited == pytest.approx(jaccard(sets[i], set(r.edited_fingerprint.split(":")[1].split(",")) - {""}))


def test_fingerprints_of_odd_rows(odd, odd_rows, none):
    got = spotsigs.fingerprint_edits(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in odd_rows)
    alone = [r for r in got if r.doc_id is None]
    assert alone[0].near_next is None and alone[0].edited_text == alone[0].edited_text[: alone[0].n_chars]
    assert spotsigs.fingerprint_edits(none).count() == 0
    assert spotsigs.fingerprint_edits(odd.where("doc_id = 1")).first().near_next == 1.0


def test_similar_pairs_are_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [sorted(rng.sample(range(10**6), rng.randint(1, 40))) for _ in range(40)]
    sets = base + [sorted(set(s[:-1]) | {rng.randrange(10**6)}) for s in base for _ in range(2)] + base[:5]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, signatures array<int>")
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(df).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    ids = sorted(first.values())
    near = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) - 1e-12
    assert got == {(a, b) for a in ids for b in ids if a < b and near(sets[a], sets[b])}


def test_similar_pairs_with_passages_that_many_texts_share(spark):
    import random

    rng = random.Random(4)
    passage = sorted(rng.sample(range(10**6), 15))
    sets = [sorted({*passage, *rng.sample(range(10**6), 25)}) for _ in range(150)]
    sets += [sorted({*passage, rng.randrange(10**6)}) for _ in range(10)] + [passage]
    sets += [sorted({*s[:-1], rng.randrange(10**6)}) for s in sets[:20]]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, signatures array<int>")
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(df).collect()}
    near = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) - 1e-12
    assert got == {(b, a) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])}


def test_windows_compared_by_words_give_the_same_counts(spark):
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(3, 40))) for _ in range(200)] + ["x y z", "x x x x", "a b c a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", qr._repeat_words_by_sorting(F.split("text", " ")).alias("slow")).collect()
    assert [r.slow for r in got] == [measure(r.text)[4] for r in got]
    # a hash of no bits makes all windows twins, so that the words decide
    words, none = F.split("text", " "), F.lit(0).cast("long")
    windows = qr._windows_of(words, none)
    forced = df.withColumns({"w": words, "x": windows, "t": qr._twins_of(windows, none)}).withColumn("s", qr._starts_of(F.col("x"), F.col("t"), F.lit(-1).cast("long")))
    out = forced.select("text", qr._repeat_words(F.col("w"), F.col("x"), F.col("t"), F.col("s"), F.lit(-1).cast("long")).alias("n")).collect()
    assert [r.n for r in out] == [measure(r.text)[4] for r in out]
