import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest import WORDS, prose  # noqa: F401
from pyspark.sql import functions as F

from plumbline.llm import language_id, pii, quality_classifier, toxicity


def held_out_labels(spark, sf_dir, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def test_language_of_held_out_documents(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.op1_language_id(spark, sf_dir).collect()
    assert len(got) == len(langs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) >= 0.98


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    # id 6 is held out, so German is learned from rows of its own
    german = [(i, prose(random.Random(i), "de", 80), "de") for i in (101, 102, 103, 104)]
    taught = odd.unionByName(spark.createDataFrame(german, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = language_id.identify(taught).collect()
    assert len(got) == len(odd_rows) + len(german)
    by = {r.doc_id: r for r in got}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == by[-3].lang_pred == "und"
    assert by[5].lang_pred == "en" and by[6].lang_pred == "de" and by[None].held_out
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ngram_counts_do_not_depend_on_company(spark):
    def buckets(texts):
        points, begins = language_id._joined(texts)
        return [sorted(x for x in b if x < 1 << 16) for b in language_id._buckets(points, 16)]

    one, two, both = buckets(["Straße ab"]), buckets(["c"]), buckets(["Straße ab", "c"])
    assert both == [sorted(x + y) for x, y in zip(one, two, strict=True)]


def plain_bayes(taught, text, bits=16):
    """(language, posterior) by counting the n-grams of every text one by one."""

    def grams(t):
        x = "".join(c if not c.isalpha() else c.lower() if len(c.lower()) == 1 else c for c in f"  {t}  ")
        x = "".join(c if c.isalpha() else " " for c in x)
        for n in (1, 2, 3):
            for i in range(len(x) - n + 1):
                g = x[i : i + n]
                if "  " in g or g == " ":
                    continue
                h = n
                for c in g:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                yield h * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - bits)

    counts, docs = {}, Counter()
    for lang, t in taught:
        docs[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(t))
    log = {}
    for lang, c in counts.items():
        under = math.log(sum(c.values()) + 0.5 * 2**bits)
        log[lang] = math.log((docs[lang] + 0.5) / (len(taught) + 0.5 * len(docs)))
        log[lang] += sum(math.log(c[b] + 0.5) - under for b in grams(text))
    best = max(log, key=log.get)
    return best, 1 / sum(math.exp(v - log[best]) for v in log.values())


def test_language_scores_are_a_plain_naive_bayes(spark):
    rng = random.Random(5)
    taught = [(lang, prose(rng, lang, 40)) for lang in ("en", "de", "en", "de", "en")]
    taught.append(("en", "Grüße aus Köln! " * 17_000 + prose(rng, "en", 500)))
    asked = ["of", "haus", "ein haus of stone", "İstanbul 1 2 3", "x" * 262_143 + "Ab", "zu " * 90_000, "wind, und wind"]
    assert any(len(t) > language_id.RUN for _, t in taught) and any(len(t) > language_id.RUN for t in asked)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(taught)], "doc_id long, lang string, text string")
    model = language_id.fit(df)
    rows = spark.createDataFrame([(i, False, t) for i, t in enumerate(asked)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()}
    for i, text in enumerate(asked):
        lang, score = plain_bayes(taught, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-3, abs=1e-6)


def test_too_many_languages_for_the_matrix_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_BYTES", 3 << 18)
    df = spark.createDataFrame([(f"l{k}", "some text") for k in range(4)], "lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(df)
    assert language_id.fit(df.where("lang < 'l2'")).langs == ["l0", "l1"]


def test_more_languages_than_a_task_holds(spark):
    rows = [(f"l{k % 150}", "some text") for k in range(450)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = {r.lang: r.n for r in language_id.count_ngrams(df).where("bucket = -1").collect()}
    assert got == {f"l{k}": 3 for k in range(150)}


def test_toxic_words_of_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        words = prose(rng, "en", rng.randint(5, 60)).split()
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["grobbish", "grobbane", "grobbent", "grobbly"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1500 and held
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) >= 0.97


def test_toxicity_of_documents(spark, sf_dir):
    truth = held_out_labels(spark, sf_dir, "toxic")
    got = toxicity.op4_toxicity(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    clean = [r for r in got if r.held_out and truth.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    toxic = [r for r in got if r.held_out and truth.get(r.doc_id) == 1]
    assert toxic and sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_toxicity_of_more_documents(spark):
    larger = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.1")
    truth = held_out_labels(spark, larger, "toxic")
    held = [r for r in toxicity.op4_toxicity(spark, larger).where("held_out").collect() if r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id] == 1]
    wrong = [r.predicted for r in held if truth[r.doc_id] == 0]
    assert len(caught) > 30 and sum(caught) >= 0.9 * len(caught)
    assert sum(wrong) <= 0.02 * len(wrong)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, labels).count() == len(odd_rows)
    assert toxicity.score(none, labels).count() == 0
    no_labels = labels.where("false")
    assert {r.score for r in toxicity.score(odd, no_labels).collect()} == {0.0}


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(3)
    n, m = 40_000, toxicity.VOTERS
    y = rng.random(n) < 0.2
    x = np.zeros((n, m), int)
    for j in range(6):
        x[:, j] = rng.random(n) < np.where(y, 0.3 + 0.1 * j, 0.02)
    x[:, 6] = x[:, 5]
    pairs = x.T @ x
    anchor = x[y][:300].mean(axis=0) - x[~y][:300].mean(axis=0)
    model = toxicity.LabelModel(n, pairs.astype(float), anchor, 0.2)
    assert model.toxic[:5] == pytest.approx([0.3, 0.4, 0.5, 0.6, 0.7], abs=0.06)
    assert model.correlation[5, 6] > 0.5 and model.trust[5] < 0.75 < model.trust[0]
    bits = (x << np.arange(m)).sum(axis=1)
    assert ((model.posterior(bits) > 0.5) == y).mean() > 0.93


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


TRICKY = [
    "a@b.c@d.e x..@y.z- @no.pe a@b a@@b.c _@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.1.1.1. v1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111",
    "+1 (708) 555-5363 +12 +1234567 ++49 30 1234567 +1234567890123456 +1-2-3-4-5-6-7-8.",
    "",
    "9" * 3000 + "@" + "a." * 500 + "z " + "a" * 3000,
    "0" * 3000 + "1.2.3.4 " + "0" * 4000 + ".0.0.00000 1." + "7" * 4000 + ".3.4",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_of_tricky_texts(text):
    assert sorted(pii.base_spans(text)) == sorted(base(text))


def test_base_spans_of_random_texts():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789" * 2 + "..@@+- ()ab") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(text)) == sorted(base(text)), text


def test_personal_data_of_documents(spark, sf_dir, texts):
    for r in pii.op7_pii(spark, sf_dir).collect():
        spans = base(texts[r.doc_id])
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in spans) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))


def test_further_spans_are_found_and_noise_is_left(spark):
    yes = [f"please call my phone 415-555-{1000 + 37 * k} today" for k in range(40)]
    yes += [f"write me by mail: user{k} (at) example (dot) com now" for k in range(40)]
    no = [f"order invoice 300-200-{4000 + k} was shipped" for k in range(40)] + ["nothing to see here"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert all(got[i].startswith(("local_phone:", "hidden_email:")) for i in range(80))
    assert all(got[i] == "" for i in range(80, 160))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "please call my phone [LOCAL_PHONE] today" and clean[159] == "nothing to see here"


def iban(country, body):
    """A valid number of that country: its check digits are what makes the remainder by 97 one."""
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


def test_further_kinds_and_their_look_alikes(spark):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], {}

    def put(text, span, kind):
        if kind:
            at = text.index(span)
            want[len(rows)] = f"{kind}:{at}:{at + len(span)}"
        rows.append((len(rows), text))

    for k in range(60):
        good = iban("DE", digits(18))
        put(f"send it to my bank account {good} please", good, "iban")
        bad = "ZZ" + good[2:4] + digits(18)
        put(f"the model number {bad} is sold out", bad, None)
        ssn = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
        put(f"his social security ssn {ssn} was lost", ssn, "national_id")
        part = f"000-{rng.randint(10, 99)}-0000"
        put(f"see section {part} of the order", part, None)
        name = f"Dr. {rng.choice(['Anna', 'Peter', 'Maria', 'John'])} {rng.choice(['Stone', 'Rivers', 'Hill'])}"
        put(f"the patient met {name} at noon", name, "person")
        put(f"nothing personal in line {k}", "", None)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want.get(i, "") for i, _ in rows}


def test_very_long_numbers_and_many_spans():
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert pii.base_spans("1.2.3." + "9" * 5000) == []
    text = "a@b.cd 10.0.0.1 +1 (708) 555-5363, or 415-555-1000 x " * 50_000
    base = pii.base_spans(text)
    assert len(base) == 150_000
    began = time.perf_counter()
    found = pii.candidates(text, base)
    assert time.perf_counter() - began < 20
    assert len(found) == 50_000 and {k for k, *_ in found} == {"local_phone"}


def test_only_overlapping_candidates_are_left_out():
    text = "415-555-1000 or 415-555-1001 or 415-555-1002"
    at = lambda taken: [a for _, a, *_ in pii.candidates(text, taken)]
    assert at([]) == [0, 16, 32] and at([("ip", 12, 16)]) == [0, 16, 32]
    assert at([("ip", 11, 13), ("card", 2, 4)]) == [16, 32] and at([("ip", 0, 17), ("card", 3, 5)]) == [32]
    assert at([("ip", 5, 6), ("card", 43, 50)]) == [16]


def test_personal_data_of_odd_rows(odd, odd_rows, none):
    assert pii.find_personal_data(odd).count() == len(odd_rows)
    assert pii.find_personal_data(none).count() == 0
    got = pii.redact(odd)
    assert got.columns == odd.columns and got.where("text is null").count() == 1


def test_overlapping_spans_are_redacted_once():
    assert pii.redacted("abcdefgh", [("ip", 1, 4), ("card", 2, 6), ("phone", 7, 8)]) == "a[IP]g[PHONE]"


def test_quality_of_documents(spark, sf_dir):
    truth = held_out_labels(spark, sf_dir, "quality")
    got = quality_classifier.op10_quality_classifier(spark, sf_dir).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [("big", "good", 0.95)] * 400 + [("big", "bad", 0.1)] * 400 + [("big", "rare", 0.1)] + [("other", "x", 0.9)] * 300 + [("tiny", "y", 0.0)]
    sites, rate = quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    assert rate == pytest.approx(sum(p for *_, p in rows) / len(rows))
    assert got["big", "bad"].site_posterior < 0.15 < got["big", "rare"].site_posterior < 0.95
    assert got["tiny", "y"].host_posterior > 0.1


def test_posteriors_are_plain_empirical_bayes(spark):
    rng = np.random.default_rng(7)
    rows = [(f"h{h}", f"p{k % (h + 1)}", float(rng.beta(2 + h, 3))) for h in range(4) for k in range(30 * (h + 1))]
    rows += [("lone", "x", 0.25)]
    sums, rate, over_hosts, over_sites = quality_classifier.site_sums(spark.createDataFrame(rows, "host string, path string, p double"))

    def strength(groups):
        spread = sum(n * (s / n - prior) ** 2 for n, s, prior in groups)
        chance = sum(prior * (1 - prior) for _, _, prior in groups)
        most = sum(n * prior * (1 - prior) for n, _, prior in groups)
        share = (spread - chance) / (most - chance)
        return min(max(1 / share - 1, 1.0), 1e6) if share > 0 else 1e6

    by_host, by_site = {}, {}
    for h, p, v in rows:
        by_host.setdefault(h, []).append(v)
        by_site.setdefault((h, p), []).append(v)
    whole = sum(v for *_, v in rows) / len(rows)
    assert rate == pytest.approx(whole)
    assert over_hosts == pytest.approx(strength([(len(v), sum(v), whole) for v in by_host.values()]))
    prior = {h: (over_hosts * whole + sum(v)) / (over_hosts + len(v)) for h, v in by_host.items()}
    assert over_sites == pytest.approx(strength([(len(v), sum(v), prior[h]) for (h, _), v in by_site.items()]))
    evidence = spark.createDataFrame(rows, "host string, path string, p double").join(sums, ["host", "path"])
    host, site = quality_classifier.posteriors(rate, over_hosts, over_sites, F.col("p"))
    for r in evidence.withColumns({"hp": host, "sp": site}).collect():
        others_h, others_s = sum(by_host[r.host]) - r.p, sum(by_site[r.host, r.path]) - r.p
        hp = (over_hosts * whole + others_h) / (over_hosts + len(by_host[r.host]) - 1)
        assert r.hp == pytest.approx(hp)
        assert r.sp == pytest.approx((over_sites * hp + others_s) / (over_sites + len(by_site[r.host, r.path]) - 1))
    alone = evidence.where("host = 'lone'").withColumns({"hp": host, "sp": site}).first()
    assert alone.hp == pytest.approx(whole) and alone.sp == pytest.approx(whole)


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (10, 0), (7, 0), (9, None)], "doc_id long, quality int")
    args = labels, F.col("source"), F.col("lang")
    assert quality_classifier.classify(odd, *args).count() == len(odd_rows)
    assert quality_classifier.classify(none, *args).count() == 0
    assert {r.evidence for r in quality_classifier.classify(odd, labels.where("false"), *args[1:]).collect()} == {0.5}
