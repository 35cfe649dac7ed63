"""Fronts without pairs against peeling over all pairs."""

import random

import numpy as np
import pytest

from plumbline.operators import fronts, selection

SCHEMA = "i long, g string, x long, y double, z long, u long"


def _peeled(rows, tiers):
    """Front by front, as the definition has it."""

    def beats(a, b):
        for tier in tiers:
            if any(a[c] is None or b[c] is None for c, _ in tier):
                return False
            wins = any(a[c] > b[c] if up else a[c] < b[c] for c, up in tier)
            losses = any(a[c] < b[c] if up else a[c] > b[c] for c, up in tier)
            if wins or losses:
                return wins and not losses
        return False

    left, found, k = list(rows), {}, 0
    while left:
        front = [a for a in left if not any(b["g"] == a["g"] and a["g"] is not None and beats(b, a) for b in left)]
        found |= {a["i"]: k for a in front}
        left, k = [a for a in left if a["i"] not in found], k + 1
    return found


@pytest.mark.parametrize(
    "tiers",
    [
        [[("x", True)]],
        [[("x", True), ("y", False)], [("z", True)]],
        [[("z", False)], [("x", True), ("y", True), ("u", False)]],
        [[("x", False)], [("y", True)], [("z", True), ("u", True)]],
        [[], [("x", True)]],
        [],
    ],
)
def test_fronts_are_peeled_pairs(spark, tiers):
    rng = random.Random(7)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    rows = [
        {"i": i, "g": rng.choice(["a", "a", "b", None]), "x": some(4), "y": None if rng.random() < 0.1 else rng.choice([-0.5, 0.0, 1.5]), "z": some(5), "u": some(3)}
        for i in range(260)
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = fronts.tiered_fronts(df, ["g"], "i", tiers)
    assert got.columns == [*df.columns, "front"]
    assert {r.i: r.front for r in got.collect()} == _peeled(rows, tiers)


def test_fronts_of_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 1, 1.0, 1, 1)] * 3 + [(2, "a", 0, 1.0, 1, 1)], SCHEMA)
    tiers = [[("x", True)], [("y", True), ("z", True)]]
    assert sorted((r.i, r.front) for r in fronts.tiered_fronts(df, ["g"], "i", tiers).collect()) == [(1, 0)] * 3 + [(2, 1)]
    assert fronts.tiered_fronts(df.limit(0), ["g"], "i", tiers).collect() == []
    with pytest.raises(ValueError, match="one tier only"):
        fronts.tiered_fronts(df, ["g"], "i", [[("x", True)], [("x", False)]])


def test_many_options_of_one_group(spark, monkeypatch):
    """20,000 options of one group; the longest chain over all pairs is made here, by numpy, and nowhere there."""
    monkeypatch.setattr(fronts, "BUCKET", 700)
    rng = np.random.default_rng(3)
    n = 20_000
    x, y, z = rng.integers(0, 2_000, n), rng.integers(0, 2_000, n), rng.integers(0, 10, n)
    df = spark.createDataFrame([(i, "a", int(x[i]), float(y[i]), int(z[i]), 0) for i in range(n)], SCHEMA)
    order = np.lexsort((-z, -y, -x))
    front = np.zeros(n, dtype=int)
    for at, i in enumerate(order):
        p = order[:at]
        beats = (x[p] >= x[i]) & (y[p] >= y[i]) & ((x[p] > x[i]) | (y[p] > y[i]) | (z[p] > z[i]))
        front[i] = (front[p][beats] + 1).max(initial=0)
    got = fronts.tiered_fronts(df, ["g"], "i", [[("x", True), ("y", True)], [("z", True)]])
    assert {r.i: r.front for r in got.collect()} == dict(enumerate(front.tolist()))
    # one criterion of many values, over several buckets
    chain = fronts.tiered_fronts(df, ["g"], "i", [[("x", True)], [("z", True)]])
    place = {v: k for k, v in enumerate(sorted(set(zip(-x, -z, strict=True))))}
    assert {r.i: r.front for r in chain.collect()} == {i: place[-x[i], -z[i]] for i in range(n)}
    with pytest.raises(ValueError, match="beyond the 1000"):
        fronts.tiered_fronts(df, ["g"], "i", [[("x", True), ("y", True)]], most=1_000)
    with pytest.raises(ValueError, match="compared pair by pair"):
        selection.tiered_pairs(df, ["g"], "i", [[("x", True)]])
