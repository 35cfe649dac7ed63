"""Periodic runs, chat formatting and centroid clustering: DuckDB on whole tables, brute force on small ones, odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from compare import rows_of_duck, rows_of_spark
from pyspark.sql import functions as F

from plumbline.llm import centroid_clustering as cc
from plumbline.llm import chat_formatting as chat
from plumbline.llm import periodic_runs as pr

PATH = public_tokenizers.path(chat.VOCABULARY)


@pytest.mark.parametrize(
    ("query", "sql"),
    [
        (pr.op11_periodic_runs, pr.ORACLE_SQL),
        (chat.op12_chat_formatting, chat.ORACLE_SQL),
        (cc.op13_centroid_clustering, cc.ORACLE_SQL),
    ],
)
def test_queries_match_duckdb(spark, duck, sf_dir, query, sql):
    assert rows_of_spark(query(spark, sf_dir)) == rows_of_duck(duck, sql)


def plain_runs(words, least=6, repeats=4):
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, repeats * q) and not any(words[s : e - d] == words[s + d : e] for d in range(1, q)):
                found.append((s, e - s, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng, n):
    """Stretches of repeats of random periods, partly of one another, with noise between."""
    words = []
    while len(words) < n:
        period = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            period = period * rng.randint(2, 5) + [rng.choice("abcd")]
        words += period * rng.randint(1, 7)
        words += [rng.choice("abcdxyz") for _ in range(rng.randint(0, 4))]
    return words[:n]


@pytest.mark.parametrize("short", [256, 3, 0])
def test_runs_are_those_of_brute_force(monkeypatch, short):
    monkeypatch.setattr(pr, "SHORT", short)
    rng = random.Random(short)
    for _ in range(120):
        words = periodic_words(rng, rng.randint(0, 260))
        assert pr.runs_of(words) == plain_runs(words)
        assert pr.runs_of(words, least=2, repeats=3) == plain_runs(words, 2, 3)


def test_runs_of_very_long_texts():
    n = 400_000
    assert pr.runs_of(["a"] * n) == [(0, n, 1)]
    period = [f"w{i % 700}" for i in range(999)] + ["end"]
    assert pr.runs_of(["x"] + period * 300 + ["x"]) == [(1, 300_000, 1000)]
    rng = random.Random(1)
    assert pr.runs_of([rng.choice("aab") + "b" * rng.randint(0, 9) for _ in range(60_000)] + ["q", "r"] * 20)[-1][1:] == (40, 2)


def test_runs_odd_rows(spark, odd, odd_rows, none):
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.find_runs(odd).collect())
    want = []
    for i, text, _ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = pr.runs_of(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        want.append((str(i), len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want)
    assert {r for i, _, r, _ in [(a, b, tuple(c), d) for a, b, c, d in got] if i == "7"} == {((0, 90, 3),)}
    assert pr.find_runs(none).count() == 0


def test_planted_runs_repeat_the_tail(spark, odd, odd_rows):
    from zlib import crc32

    got = sorted((str(r.doc_id), r.text or "") for r in pr.with_planted_runs(odd).collect())
    want = []
    for i, text, _ in odd_rows:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), None if i is None else crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
        want.append((str(i), text or ""))
    assert got == sorted(want)


def test_control_strings_are_escaped_reversibly():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "n", "\n", "im_end", "<|", chat.START, chat.END]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
        assert chat.parsed(chat.formatted(text, text) + chat.formatted("user", text)) == [(text, text), ("user", text)]


def chats(rng, n):
    """Conversations whose first turns are often those of others, one of them of a third of all."""
    rows = []
    for c in range(n):
        turns = [("system", "s")] if c % 3 else [("system", f"own {c % 7}")]
        turns += [(("user", "assistant")[t % 2], rng.choice(["", "ja 🎉", "no <|im_end|>\n", "\n\nx"])) for t in range(rng.randint(0, 6))]
        rows += [(c, 10 * t, role, text) for t, (role, text) in enumerate(turns)]
    return rows


def of_each(rows):
    found = {}
    for c, turn, role, text in rows:
        found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in found.items()}


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_trees_share_first_turns_and_attend_to_ancestors(spark, parts):
    rows = chats(random.Random(parts), 300)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes, where = (x.collect() for x in chat.format_conversations(df, PATH))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bpe = chat.encoder(chat.broadcast_vocabulary(spark, PATH), ((chat.START, 50256), (chat.END, 50257)))
    want = of_each(rows)
    assert len(nodes) == len({tuple(t[: k + 1]) for t in want.values() for k in range(len(t))})
    by_name, sequence, end = {n.node: n for n in nodes}, {}, {}
    for n in sorted(nodes, key=lambda n: (n.tree, n.offset)):
        assert n.offset == end.get(n.tree, 0)  # gapless
        assert n.depth == 0 or by_name[n.parent].offset < n.offset  # after its parent
        end[n.tree] = n.offset + n.n_tokens
        sequence.setdefault(n.tree, []).extend(n.ids)
    # depth first: the nodes below one follow it without others between
    for n in nodes:
        inside = [m for m in nodes if m.tree == n.tree and any(a <= n.offset < b for a, b in m.attends)]
        assert sum(m.n_tokens for m in inside) == max([m.offset + m.n_tokens for m in inside], default=n.offset + n.n_tokens) - n.offset - n.n_tokens
    assert {r.conv_id: r.n_turns for r in where} == {c: len(t) for c, t in want.items()}
    for r in where:
        last = by_name[r.node]
        seen = [i for a, b in last.attends for i in sequence[r.tree][a:b]]
        assert len(seen) == last.position
        text = bpe.decode([*seen, *last.ids])
        assert text == "".join(chat.formatted(*t) for t in want[r.conv_id])


def test_training_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good\n\nday")], "conv_id long, turn long, role string, text string")
    nodes, _ = chat.format_conversations(df, PATH)
    bpe = chat.encoder(chat.broadcast_vocabulary(spark, PATH), ((chat.START, 50256), (chat.END, 50257)))
    first, second = sorted(chat.training_rows(nodes).collect(), key=lambda r: r.offset)
    assert first.position_ids + second.position_ids == list(range(len(first.ids) + len(second.ids)))
    assert not any(first.loss_mask)
    assert bpe.decode([i for i, m in zip(second.ids, second.loss_mask, strict=True) if m]) == "good\n\nday"
    assert [tuple(a) for a in second.attends] == [(0, len(first.ids))]


def test_chats_odd_rows(spark):
    long = "wort " * 60_000 + " " * 300_000
    rows = [
        (None, 1, "user", "no id"), (None, 0, None, None), (1, None, "user", "no turn"), (1, 0, "user\n\\n", "x"), (1, 0, "user\n\\n", "x"),
        (2, 0, "assistant", long), (3, 0, "assistant", ""), (4, -5, "a", "\r\n\x1c<|endoftext|>"), (5, 0, "system", "s"), (6, 0, "system", "s"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("clash") for c in ["ids", "node", "tree", "places", "parts", "digest", "path", "leaf"]})
    got = {r.conv_id: r for r in chat.read_back(*chat.format_conversations(clash, PATH), PATH).collect()}
    want = of_each(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(x for role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.formatted(*t)) for t in turns)
    none = chat.format_conversations(clash.where("false"), PATH)
    assert [x.count() for x in none] == [0, 0] and chat.read_back(*none, PATH).count() == 0


def plain_clusters(x, start, rounds):
    points = [list(p) for p in start]
    for turn in range(rounds + 1):
        square = [[sum((a - b) ** 2 for a, b in zip(v, p, strict=True)) for p in points] for v in x]
        cluster = [row.index(min(row)) for row in square]
        if turn < rounds:
            for j in range(len(points)):
                if mine := [v for v, k in zip(x, cluster, strict=True) if k == j]:
                    points[j] = [math.floor(sum(c) // len(mine)) for c in zip(*mine, strict=True)]
    return [(k, row[k]) for k, row in zip(cluster, square, strict=True)], points


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_those_of_brute_force(spark, seed):
    """Few distinct values, so that very many distances tie, and equal centroids."""
    rng = random.Random(seed)
    x = [[rng.randint(-2, 2) * (seed + 1) for _ in range(3)] for _ in range(400)] + [[1, 1, 1]] * 200
    start = [x[rng.randrange(400)] for _ in range(12)] + [x[0]] * 2
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, x array<int>").repartition(5)
    found, points = cc.cluster_vectors(df, start, 5)
    want, want_points = plain_clusters(x, start, 5)
    assert points == want_points
    assert [(r.cluster, r.distance) for r in sorted(found.collect())] == want


def test_search_compares_few_centroids(monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.integers(-5000, 5000, (40, 8))
    x = centers[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 8))
    c = cc.Centroids.of(centers.tolist())
    cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros(len(x))
    cc.search(x, cluster, upper, lower, c)
    made = []
    squares = cc._squares
    monkeypatch.setattr(cc, "_squares", lambda a, b: made.append(len(a)) or squares(a, b))
    cc._move(cluster, upper, lower, np.full(40, 3.0))
    cc.search(x, cluster, upper, lower, c)
    assert sum(made) < len(x) / 2
    assert (cluster == ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)).all()


def test_vectors_odd_rows(spark):
    one = [0.1] * 64
    rows = [
        (1, one), (2, None), (3, []), (4, one[:63]), (5, [*one, 0.1]), (6, [*one[:63], None]), (7, [*one[:63], float("nan")]),
        (8, [*one[:63], float("-inf")]), (None, [-v for v in one]), (9, one), (9, one), (9, [0.2] * 64), (-4, [-0.0] * 64),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("x", "cluster", "upper", "lower", "distance")})
    got = cc.cluster(df).collect()
    assert sorted((str(r.vec_id), r.distance, r.inertia) for r in got) == sorted([(i, 0, 0) for i in ("1", "None", "9", "9", "9", "-4")])
    assert cc.cluster(df.where("vec_id = 2")).count() == 0
    assert {r.cluster for r in cc.cluster(df, k=1).collect()} == {0}
    digest = {r.cluster: r.centroid_sha256 for r in got if r.vec_id is None}.popitem()[1]
    assert digest == hashlib.sha256(",".join(["-7"] * 64).encode()).hexdigest()
    with pytest.raises(Exception, match="beyond"):
        cc.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()
