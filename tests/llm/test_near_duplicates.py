import random
from collections import defaultdict

import pytest
from conftest import prose  # noqa: F401

from plumbline.llm import _graph
from plumbline.llm import ngram_jaccard_join as nj


def brute(texts):
    """class and number of links of every id."""
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    sets = {}
    for t, i in first.items():
        w = t.lower().encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[min(a, b), max(a, b)] += 1
    links, parent = defaultdict(int), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (find(first[t]), links[first[t]]) for i, t in texts.items()}


def test_documents_are_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.op9_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("block", [16, 256])
def test_a_large_group_of_near_copies_loses_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", block)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    for i in range(150, 200):
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(80))
    texts |= {200: texts[0], 201: texts[3].upper(), 202: "few words", 203: "Few  words", 204: "", 205: " "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.near_duplicates(df).collect()}
    want = brute(texts)
    assert sum(n for _, n in want.values()) > 500
    assert got == want


def test_odd_rows(odd, odd_rows, none):
    got = nj.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {r.class_id for i in (7, 8) for r in by[i]} == {7} and by[8][0].n_copies == 3
    assert by[2][0].class_id == by[3][0].class_id == 2 and by[4][0].class_id == 4
    assert by[None][0].n_links == 0
    assert nj.near_duplicates(none).count() == 0


def test_banding_reaches_its_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = nj.choose_bands(threshold, 0.9999, 256)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999 and bands * rows <= 256
    with pytest.raises(ValueError):
        nj.choose_bands(0.1, 0.9999, 8)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    ring = [(3000 + k, 3000 + (k + 1) % 17) for k in range(17)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in chain + star + ring] + [(5, 6), (9, 9)]
    rng.shuffle(edges)
    got = dict(_graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(1000, 1200), 1000), **dict.fromkeys(range(3000, 3017), 3000)}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    rounds = []
    plain = _graph.contract

    def counted(edges, turn):
        rounds.append(turn)
        return plain(edges, turn)

    monkeypatch.setattr(_graph, "contract", counted)
    chain = [(i, i + 1) for i in range(5000)]
    short = [(10_000 + i, 10_001 + i) for i in range(100)]
    star = [(20_000, 20_000 + k) for k in range(1, 10_000)]
    ring = [(40_000 + k, 40_000 + (k + 1) % 1000) for k in range(1000)]
    df = spark.createDataFrame(chain + short + star + ring + [(None, 3), (7, None)], "a long, b long")
    got = dict(_graph.components(df).collect())
    assert len(rounds) <= 20
    firsts = {0: 5001, 10_000: 101, 20_000: 10_000, 40_000: 1000}
    assert got == {first + k: first for first, n in firsts.items() for k in range(n)}


def test_many_rows_without_an_id(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = [(None, " ".join(rng.choice(vocabulary) for _ in range(12))) for _ in range(5000)]
    rows += [(None, "one text for all of them")] * 2000
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7000 and {(r.doc_id, r.class_id, r.n_links) for r in got} == {(None, None, 0)}
    assert sorted(r.n_copies for r in got) == [1] * 5000 + [2000] * 2000


def test_a_pair_that_shares_all_bands_counts_once(spark):
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(3000)]
    words = [rng.choice(vocabulary) for _ in range(400)]
    rows = [(k, " ".join([*words[:-1], f"end{k}"])) for k in range(5)]
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 4)}
