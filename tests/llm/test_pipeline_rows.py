import random

import corpus_pipeline
from conftest import prose
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_odd_rows_that_survive_deduplication(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "score", "kept")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([None, -3, 1, 2, 4, 5, 6, 6, 7, 9, 10], key=str)


def test_each_group_keeps_one_row_whatever_its_ids(spark, sf_dir):
    rng = random.Random(11)
    alone, shared, nameless, repeated, near, third = (prose(rng, "en", 70) for _ in range(6))
    rows = [
        (None, alone),
        (None, shared), (3, shared), (4, shared),
        (None, nameless), (None, nameless), (None, nameless + " end"),
        (5, repeated), (5, repeated), (5, repeated),
        # the second text of id 6 belongs to a group that 2 stands for, the third one to none
        (6, prose(rng, "de", 70)), (6, near + " end"), (2, near), (6, third),
    ]
    got = ids_and_texts(corpus_pipeline.drop_near_duplicates(spark, table_of(spark, rows), sf_dir))
    nameless_kept = [t for i, t in got if i is None and t.startswith(nameless)]
    assert len(nameless_kept) == 1
    assert got == sorted(
        [(None, alone), (3, shared), (None, nameless_kept[0]), (5, repeated), (6, rows[10][1]), (2, near), (6, third)], key=str
    )


def test_each_row_has_its_own_toxicity_verdict(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []

    def text(bad):
        words = prose(rng, "en", rng.randint(20, 60)).split()
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["grobbish", "grobbane", "grobbent", "grobbly"]))
        return " ".join(words)

    for i in range(1500):
        rows.append((i, text(i % 8 == 0)))
        labels.append((i, int(i % 8 == 0), 1))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    bad, good = text(True), text(False)
    more = [(None, bad), (None, good), (5000, bad), (5000, good), (5001, good), (5001, good), (5002, bad), (5002, bad)]
    got = corpus_pipeline.drop_toxic(spark, table_of(spark, rows + more), str(tmp_path))
    of_more = [r for r in ids_and_texts(got) if r[0] is None or r[0] >= 5000]
    assert of_more == sorted([(None, good), (5000, good), (5001, good), (5001, good)], key=str)
