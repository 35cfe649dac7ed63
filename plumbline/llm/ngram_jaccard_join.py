"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Equal texts are one class.  Classes that share a band hash share a bucket; of buckets with the very same members one
stays.  Each bucket is cut into blocks of bounded size; a pair of blocks is one unit of work, which compares the full
n-gram sets of its classes and gives out the number of links of each class and a spanning forest of the links.  A pair
that shares several buckets counts in the first of them only, so no pair has to be given out to be counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._graph import components
from ._storage import cut, table

WORDS = 5
THRESHOLD = 0.8
#: Probability that a pair exactly at the threshold becomes a candidate, and the MinHash values it may cost.
RECALL = 0.9999
MOST_HASHES = 128
#: Classes in a block, about.
BLOCK = 128
#: Stands for a null id in joins.
NO_ID = -(1 << 63)

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("cid", pa.int64()), ("grams", pa.binary())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def choose_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``most`` hashes whose recall at ``threshold`` is ``recall``."""
    best = None
    for r in range(1, most + 1):
        p = threshold**r
        b = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if b * r <= most:
            best = (b, r)
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


def digest(text: Column) -> Column:
    """SHA-256 of the text; null text is empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def id_of(doc_id: Column) -> Column:
    """The id as joins have it."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes (uint64, with repeats) of the word n-grams of a text: lower-case words between ASCII white space.  A text
    of fewer words is one n-gram; a text without words has none."""
    split = text.lower().encode().split()
    if not split:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(split, dtype=object), categorize=False)
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    a = random.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, random.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash_bands(grams: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """One int64 per band; equal for two sets if the band's MinHash values are."""
    a, b = _hashes(bands * per_band)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 512):
            least = np.minimum(least, (np.multiply.outer(grams[at : at + 512], a) + b).min(axis=0))
        mixed = np.arange(1, bands + 1, dtype=np.uint64)
        for column in least.reshape(bands, per_band).T:
            mixed = (mixed ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a unit, from its 0/1 incidence matrix in bounded runs of columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    number = np.cumsum(shared) - 1
    inside = shared[column]
    owner, column = owner[inside], number[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[i:j], column[i:j] - low] = 1
        out += x @ x.T
    return out


def _unit(members: list[tuple[int, int, list[int], bytes]], threshold: float) -> Iterator[tuple]:
    """(a, b, links) rows of one unit of (class, block, earlier buckets, n-grams): the links of each class, and the edges
    of a spanning forest of the links, over the pairs that share no earlier bucket."""
    ids = [c for c, _, _, _ in members]
    blocks = np.array([b for _, b, _, _ in members])
    own = ~np.eye(len(ids), dtype=bool)
    if blocks.min() != blocks.max():
        own &= blocks[:, None] != blocks[None, :]
    earlier = [np.array(e, np.int64) for _, _, e, _ in members]
    if sum(map(len, earlier)):
        own &= _overlaps(earlier) == 0
    if not own.any():
        return
    sets = [np.frombuffer(g, np.uint64) for _, _, _, g in members]
    sizes = np.array([len(s) for s in sets], np.float64)
    common = _overlaps(sets)
    linked = own & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6)
    counts = linked.sum(axis=1)
    seen = np.zeros(len(ids), bool)
    for k in range(len(ids)):
        if counts[k]:
            yield ids[k], None, int(counts[k])
        front = [k] if counts[k] and not seen[k] else []
        seen[k] = True
        while front:
            i = front.pop()
            for j in np.flatnonzero(linked[i] & ~seen):
                seen[j] = True
                front.append(j)
                yield ids[i], ids[j], 0


def _classes(
    docs: DataFrame, threshold: float, words: int, recall: float, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Every row (``doc_id, digest, bands``), and every distinct text (``cid, digest, rep, n_copies, n_links,
    component``): ``rep`` is the least id that has it, ``component`` what links connect it with."""
    bands, per_band = choose_bands(threshold, recall, MOST_HASHES)
    slim = docs.select(
        id_of(F.col(id_col)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        digest(F.col(text_col)).alias("digest"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_SIGNATURE)
        for doc_id, own, text in rows(batches, "doc_id", "digest", "text"):
            grams = shingles(text, words)
            found = minhash_bands(grams, bands, per_band) if len(grams) else []
            yield from out.add((doc_id, own, found))
        yield from out.flush()

    signed = cut(slim.mapInArrow(sign, "doc_id long, digest binary, bands array<long>"))
    named = F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    classes = (
        signed.groupBy("digest")
        .agg(F.coalesce(named, F.lit(NO_ID)).alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = cut(classes)

    banded = classes.select("cid", F.explode("bands").alias("band"))
    # two 64-bit sums of hashes, the count and the least member tell the members of buckets apart
    prints = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"print{k}") for k in range(2)]
    buckets = (
        banded.groupBy("band")
        .agg(F.min("cid").alias("first"), F.count("*").alias("n"), *prints)
        .where(F.col("n") > 1)
        .groupBy("first", "n", "print0", "print1")
        .agg(F.min("band").alias("band"))
        .select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    # at most one bucket a band for each class
    places = cut(
        banded.join(cut(buckets), "band")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("band", "blocks"))).alias("buckets"))
    )
    wanted = places.select("cid").join(classes.select("cid", F.col("rep").alias("doc_id"), "digest"), "cid")

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_SETS)
        for cid, text in rows(batches, "cid", "text"):
            grams = np.unique(shingles(text, words)).tobytes()
            yield from out.add((cid, grams), len(grams))
        yield from out.flush()

    # repeated rows of one class give its set once
    sets = (
        slim.join(wanted, ["doc_id", "digest"])
        .mapInArrow(gram_sets, "cid long, grams binary")
        .groupBy("cid")
        .agg(F.first("grams").alias("grams"))
    )
    at = F.col("k")
    units = (
        sets.join(places, "cid")
        .select("cid", "grams", F.col("buckets.band").alias("bands"), F.posexplode("buckets").alias("k", "bucket"))
        .withColumn("block", F.pmod(F.xxhash64("cid", "bucket.band"), F.col("bucket.blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bucket.blocks") - 1)))
        .select(
            F.col("bucket.band").alias("band"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "cid", "block", F.slice("bands", F.lit(1), at).alias("earlier"), "grams",
        )
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j", "cid")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_FOUND)
        stream = rows(batches, "band", "i", "j", "cid", "block", "earlier", "grams")
        for _, unit in groupby(stream, key=lambda r: r[:3]):
            members = [r[3:] for r in unit]
            if len(members) > 1:
                for row in _unit(members, threshold):
                    yield from out.add(row)
        yield from out.flush()

    found = cut(units.mapInArrow(compare, "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("n_links"))
    joined = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("id", "cid")

    known = cut(
        classes.drop("bands")
        .join(links, "cid", "left")
        .join(joined, "cid", "left")
        .withColumns({"component": F.coalesce("component", "cid"), "n_links": F.coalesce("n_links", F.lit(0))})
    )
    return signed, known


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least id among the documents that links and copies connect
    with it), ``n_links`` (the other texts whose n-gram set has a Jaccard similarity of ``threshold`` with its own) and
    ``n_copies`` (the documents with its very text, itself included).

    Null text is empty text; texts without words are linked to none, but equal ones are copies.  Repeated rows are
    copies.  A null id stays null and is never a class's name unless the class has no other.  An empty table gives
    an empty result; further columns are not read.
    """
    signed, known = _classes(docs, threshold, words, recall, id_col, text_col)
    least = F.min(F.when(F.col("rep") != NO_ID, F.col("rep")))
    leaders = cut(known.groupBy("component").agg(least.alias("class_id")))
    named = cut(
        known.join(leaders, "component").select("digest", "class_id", "n_links", "n_copies")
    )
    return signed.join(named, "digest").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "class_id", "n_links", "n_copies"
    )


def representatives(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row ``id, digest`` per class of ``near_duplicates``: that of the least id, as ``id_of`` and ``digest`` of a
    document have them.  A null id stands for a class only if all its ids are null; of several texts under one id the
    least digest is taken.  A repeated row has the same id and digest.
    """
    _, known = _classes(docs, threshold, words, recall, id_col, text_col)
    first = F.min(F.struct(F.col("rep") == NO_ID, F.col("rep").alias("id"), "digest")).alias("first")
    return known.groupBy("component").agg(first).select("first.id", "first.digest")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
