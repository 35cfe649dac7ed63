import random

import pytest

WORDS = {
    "en": "the house of a small river and that water was on with light for stone by wind at night from field".split(),
    "de": "der wald und die straße von haus zu licht mit wasser für auf stein nicht eine nacht wind im feld sich".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, blanks, a very long one, ties, repeated rows, a repeated and a null id, other scripts."""
    rng = random.Random(3)
    long = prose(rng, "en", 60_000)
    return [
        (1, prose(rng, "en", 80), "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \t\n  ", "de"),
        (5, long, "en"),
        (6, prose(rng, "de", 90), "de"),
        (6, prose(rng, "de", 90), "de"),
        (7, "same text here " * 30, "en"),
        (8, "same text here " * 30, "en"),
        (8, "same text here " * 30, "en"),
        (None, "a text without an id " + prose(rng, "en", 60), "en"),
        (9, "語言 🎉 café́ \x1c x y <|endoftext|> don't", None),
        (10, "x" * 40_000, "de"),
        (-3, "1234 5678", None),
    ]


#: Names that operators use for their own columns.
CLASH = (
    "size shard slot text_crc32 key_hi kept n_words broken_rules item total members offset group block code word held_out score predicted "
    "lang_pred votes hits label host path p digest bands rep cid component spans id next_id given edited signatures id_"
).split()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string").repartition(3)
    return df.select("*", F.lit("src").alias("source"), *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}
