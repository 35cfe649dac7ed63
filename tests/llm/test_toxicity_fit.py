"""The lexicon, hits, votes and scores of toxicity against plain Python; samples stay bounded under repeated ids."""

import math
import random
import re
from collections import Counter

import numpy as np
from conftest import prose
from pyspark.sql import functions as F

from plumbline.llm import quality_classifier, toxicity
from plumbline.llm._storage import held_out


def plain_features(text):
    counts = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    own = {f"w:{w}" for w in counts} | {f"b{k}:{w[:k]}" for w in counts for k in range(4, 9) if len(w) > k}
    twice = Counter()
    for w, n in counts.items():
        for k in range(4, 8):
            if len(w) > k:
                twice[f"m{k}:{w[:k]}"] += n
    return own | {f for f, n in twice.items() if n > 1}


def plain_lexicon(rows):
    """In whole numbers, every threshold tried for every kind and number of documents."""
    df, of_toxic = Counter(), Counter()
    for text, label in rows:
        for f in plain_features(text):
            df[f] += 1
            of_toxic[f] += label
    n, n1 = len(rows), sum(label for _, label in rows)
    chosen = {}
    for kind, d in {(f.split(":")[0], d) for f, d in df.items() if d > 1}:
        mine = [f for f in df if df[f] == d and f.split(":")[0] == kind]
        tail, above = 0, []
        for t in range(d, 0, -1):  # in units of 1 / n ** d
            tail += math.comb(d, t) * n1**t * (n - n1) ** (d - t)
            at_least = [f for f in mine if of_toxic[f] >= t]
            if at_least and 10 * len(mine) * tail <= len(at_least) * n**d:
                above = at_least
        for f in above:
            odds = math.log((of_toxic[f] + 0.1) / (n1 + 0.2)) - math.log((d - of_toxic[f] + 0.1) / (n - n1 + 0.2))
            if odds >= 2.5:
                chosen[f] = odds * math.log1p(of_toxic[f])
    return sorted(chosen, key=lambda f: (-round(chosen[f], 9), f))


def said(rng, toxic):
    bad = [f"{a}{b}" for a in ("blark", "grizzo", "snuffle") for b in ("", "s", "ing", "ed")]
    words = prose(rng, "en", rng.randint(20, 40)).split()
    words += [rng.choice(bad)] * rng.randint(1, 3) if toxic else []
    words += ["stupid", "you"] if rng.random() < (0.5 if toxic else 0.02) else []
    words += ["nooooo!!!", "a!! b!! c!!"] if rng.random() < 0.1 else []
    rng.shuffle(words)
    return " ".join([*words, f"mark{rng.random():.12f}".replace(".", "x")])


def taught(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, said(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    held = {r.doc_id for r in df.where(held_out(F.col("doc_id"))).collect()}
    return rows, df, held


def test_lexicon_and_scores_are_those_of_plain_python(spark):
    rows, df, held = taught(spark)
    lexicon = plain_lexicon([(t, label) for i, t, label in rows if i not in held])
    fitted = df.where(~held_out(F.col("doc_id")))
    assert 5 < len(lexicon) and toxicity.learn_lexicon(fitted) == lexicon

    voted = {r.doc_id: r for r in toxicity.vote(df.withColumn("held_out", F.lit(False)), lexicon).collect()}
    kinds = Counter(f.split(":")[0] for f in lexicon)
    seen, voter = Counter(), []
    for f in lexicon:
        kind = f.split(":")[0]
        before = sum(toxicity.FOLDS_OF[k] for k in list(toxicity.FOLDS_OF)[: list(toxicity.FOLDS_OF).index(kind)])
        voter.append(before + seen[kind] * toxicity.FOLDS_OF[kind] // kinds[kind])
        seen[kind] += 1
    first = sum(toxicity.FOLDS_OF.values())
    for i, text, _ in rows:
        there = plain_features(text)
        hits = [k for k, f in enumerate(lexicon) if f in there]
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        bits = {voter[k] for k in hits}
        bits |= {first + k for k, on in enumerate([
            words & toxicity.INSULTS, words & toxicity.INSULTS and words & {"you", "your"}, len(hits) > 1,
            len(re.findall("!!+", text)) > 2, re.search(r"([^\W\d_])\1\1\1", text),
        ]) if on}
        assert voted[i].hits == hits and voted[i].votes == sum(1 << b for b in bits)

    x = np.array([[voted[i].votes >> b & 1 for b in range(toxicity.VOTERS)] for i, _, _ in rows], float)
    label = np.array([y for _, _, y in rows])
    fold = np.array([i not in held for i, _, _ in rows])
    anchor = x[fold & (label == 1)].mean(0) - x[fold & (label == 0)].mean(0)
    model = toxicity.LabelModel(len(x), x.T @ x, anchor, label[fold].mean())
    inside = [voted[i] for i, _, _ in rows if i not in held]
    constant, w = toxicity.train_linear([r.hits for r in inside], model.posterior(np.array([r.votes for r in inside])), len(lexicon))
    labels = df.select("doc_id", F.col("label").alias("toxic"))
    for r in toxicity.score(df, labels).collect():
        z = constant + sum(w[k] for k in voted[r.doc_id].hits)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.held_out == (r.doc_id in held)


def test_a_lexicon_has_no_cap(spark):
    rng = random.Random(2)
    own = [f"tox{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(5000)]
    rows = []
    for i in range(240):
        toxic = i % 2
        words = [w for k, w in enumerate(own) if (k + i // 2) % 12 == 0] if toxic else prose(rng, "en", 60).split()
        rng.shuffle(words)  # else near copies, of which one counts
        rows.append((i, " ".join([*words, f"only{i}"]), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert len([f for f in toxicity.learn_lexicon(df) if f.startswith("w:")]) == 5000


def test_one_rule_at_every_frequency():
    """In 5,000 documents too, what chance explains is not chosen, and what it does not is."""
    assert toxicity._beyond_chance([("w", 5000, 500, 900), ("w", 5000, 700, 1)], 0.1) == [("w", 5000, 700)]
    assert toxicity._beyond_chance([("w", 5000, 500, 900), ("w", 5000, 560, 1)], 0.1) == []
    assert toxicity._beyond_chance([], 0.1) == []


def test_samples_stay_bounded_under_a_repeated_id(spark, monkeypatch):
    rows, df, held = taught(spark)
    one = next(i for i, _, label in rows if label and i not in held)
    many = spark.range(200_000).select(
        F.lit(one).alias("doc_id"), F.concat(F.lit("blarking blarks of a house "), (F.col("id") % 1000).cast("string")).alias("text")
    )
    docs = df.select("doc_id", "text").unionByName(many)
    labels = df.select("doc_id", F.col("label").alias("toxic"), F.col("label").alias("quality"))
    fits = []
    train, fit = toxicity.train_linear, quality_classifier.logistic
    monkeypatch.setattr(toxicity, "train_linear", lambda hits, *a: fits.append(len(hits)) or train(hits, *a))
    monkeypatch.setattr(quality_classifier, "logistic", lambda x, *a: fits.append(len(x)) or fit(x, *a))
    scored = toxicity.score(docs, labels, sample=300)
    assert scored.count() == 200_600 and 0 < fits[0] < 450
    by = {r.doc_id: r.score for r in scored.where(F.col("doc_id") != one).collect()}
    of = [[by[i] for i, _, label in rows if i in held and label == y] for y in (0, 1)]
    assert sum(a < b for a in of[0] for b in of[1]) >= 0.8 * len(of[0]) * len(of[1])
    classified = quality_classifier.classify(docs, labels, F.lit("h"), F.lit("p"), sample=300)
    assert classified.count() == 200_600 and 0 < fits[1] < 450


def test_equal_rows_weigh_as_many(spark):
    rows, df, _ = taught(spark, 200)
    labels = df.select("doc_id", F.col("label").alias("quality"))
    once = {r.doc_id: r.evidence for r in quality_classifier.classify(df, labels, F.lit("h"), F.lit("p")).collect()}
    thrice = df.unionByName(df).unionByName(df)
    again = {r.doc_id: r.evidence for r in quality_classifier.classify(thrice, labels, F.lit("h"), F.lit("p")).collect()}
    # the ridge weighs a third as much
    assert all(abs(once[i] - again[i]) < 0.1 for i in once)
