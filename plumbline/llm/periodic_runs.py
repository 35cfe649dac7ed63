"""Periodic runs of words, by bit-parallel lags.

The words of a text become small numbers, and each binary digit of these numbers a plane: one big integer with a bit per
word.  A plane XOR itself shifted by a lag marks the words that differ from the one a lag further on; ORed over all planes,
what stays 0 is equal, and shift-doubling AND leaves only stretches of equal words that are long enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._storage import table
from .quality_rules import WORD

#: A run has at least so many words, and at least so many times its period.
LEAST = 6
REPEATS = 4
#: Lags up to this are tested on all words; longer ones around their anchors, see ``_anchored``.
SHORT = 256

_WORDS = re.compile(WORD)
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ]
)


def _planes(ids: np.ndarray) -> list[int]:
    width = int(ids.max()).bit_length() if len(ids) else 0
    bits = ((ids >> b) & 1 for b in range(width))
    return [int.from_bytes(np.packbits(x.astype(np.uint8), bitorder="little").tobytes(), "little") for x in bits]


def _stretches(planes: list[int], n: int, lag: int, need: int) -> list[tuple[int, int]]:
    """(first word, end) of every longest stretch of ``n`` words in which at least ``need`` words in a row equal the
    word ``lag`` further on; the stretch includes those they equal."""
    differ = 0
    for p in planes:
        differ |= p ^ (p >> lag)
    equal = ~differ & ((1 << (n - lag)) - 1)
    have = 1
    while equal and have < need:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    if not equal:
        return []
    raw = np.frombuffer(equal.to_bytes(n // 8 + 1, "little"), np.uint8)
    edges = np.diff(np.unpackbits(raw, bitorder="little").astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(int(s), int(e) - 1 + need + lag) for s, e in zip(starts, ends, strict=True)]


def _anchored(ids: np.ndarray, lag: int, reach: np.ndarray, repeats: int) -> Iterator[tuple[int, int]]:
    """Windows of ``ids`` that hold every run of this period whole.

    A run covers at least ``repeats`` multiples of its period in a row, all with the same word, so comparing every
    ``lag``-th word finds where it can be; a run shares less than two periods with one of a smaller period, so three
    multiples within such a run (``reach`` is the furthest end of the runs that begin up to a word) rule a place out.
    Other remainders than 0 are compared where that leaves any place.
    """
    words = ids[::lag]
    same = words[1:] == words[:-1]
    m = len(words) - repeats + 1
    at = same[:m].copy()
    for t in range(1, repeats - 1):
        at &= same[t : t + m]
    k = np.flatnonzero(at)
    for r in (lag // 3, lag - lag // 3, lag - 1) if len(k) else ():
        kept = np.zeros(len(k), bool)
        for first in (k * lag + r, (k - 1) * lag + r):
            inside = (first >= 0) & (first + (repeats - 1) * lag < len(ids))
            place = first[inside]
            hit = np.ones(len(place), bool)
            for t in range(1, repeats):
                hit &= ids[place] == ids[place + t * lag]
            kept[inside] |= hit
        k = k[kept]
    for t in range(repeats - 2):
        k = k[reach[(k + t) * lag] <= (k + t + 2) * lag]
    for group in np.split(k, np.flatnonzero(np.diff(k) > 1) + 1) if len(k) else ():
        yield max(0, (int(group[0]) - 1) * lag), min(len(ids), (int(group[-1]) + repeats) * lag)


def _runs_of_stretch(ids: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    n = len(ids)
    planes = _planes(ids)
    reach = np.zeros(n, np.int64)
    found: list[tuple[int, int, int]] = []
    for lag in range(1, n // repeats + 1):
        need = max(least, repeats * lag) - lag
        if lag <= SHORT:
            stretches = _stretches(planes, n, lag, need)
        else:
            stretches = [
                (low + s, low + e)
                for low, high in _anchored(ids, lag, reach, repeats)
                for s, e in _stretches(_planes(ids[low:high]), high - low, lag, need)
            ]
        # two periods of one stretch have a common divisor that is a period too, so a stretch with a smaller period
        # lies within a run of that period, which an earlier lag has found
        new = [(s, e) for s, e in stretches if reach[s] < e]
        if new:
            found += [(s, e - s, lag) for s, e in new]
            for s, e in new:
                reach[s] = max(reach[s], e)
            reach = np.maximum.accumulate(reach)
    return found


def runs_of(words: list[str], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start, then period.

    A word that occurs less than ``repeats`` times is in no run; the stretches between such words are searched one by one.
    """
    if repeats < 3:
        raise ValueError("a run repeats its period at least three times")
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    often = np.bincount(ids, minlength=1) >= repeats
    if not often.any():
        return []
    alive = often[ids]
    ids = np.cumsum(often)[ids]
    edges = np.diff(alive.astype(np.int8), prepend=0, append=0)
    found = []
    for low, high in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        if high - low >= least:
            found += [(low + s, length, q) for s, length, q in _runs_of_stretch(ids[low:high], least, repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: int = REPEATS
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text.

    A run is a stretch of words with a smallest period q, at least ``repeats`` times q and ``least`` words long, that
    reaches as far as the period holds; ``runs`` is an array of ``start, length, period`` by start, then period.
    ``collapsed`` is the text without what repeats: the words, but of each run only its first period, joined by blanks.

    Null text is empty: no words, no runs and an empty ``collapsed``.  Null ids stay null, repeated rows stay, further columns are not
    read, an empty table gives an empty result.  A text is worked on by one task; its cost grows with its length (times
    its logarithm), also where one word repeats all along.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_OUT)
        for doc_id, text in rows(batches, "doc_id", "text"):
            words = _WORDS.findall(text or "")
            found = runs_of(words, least, repeats)
            kept = words
            if found:
                stay = np.ones(len(words), bool)
                for start, length, period in found:
                    stay[start + period : start + length] = False
                kept = [words[i] for i in np.flatnonzero(stay)]
            yield from out.add((doc_id, len(words), found, " ".join(kept)), len(text or "") + 24 * len(found))
        yield from out.flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(search, _SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the texts whose id has a crc32 that ends in 0 repeat from some word on, as the query's contract sets."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    found = found.withColumn("n", F.size("words").cast("long"))
    found = found.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    found = found.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int(ceil((n - a) / p)))), 1, int(n - a))")
    planted = F.concat_ws(" ", F.expr("slice(words, 1, int(a))"), tail)
    return found.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("longest.length * 1000 div -longest.p").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of the decimal id, a step per byte and eight per bit; pairs of equal words by a join within the document.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM documents
), h AS (
  SELECT rid, doc_id, words, len(words) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, steps::BIGINT[]),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) AS h
  FROM d
), g AS (
  SELECT rid, doc_id, words, n, h % 10 = 0 AND n > 0 AS planted, h // 10 AS g FROM h
), a AS (
  SELECT *, CASE WHEN planted THEN g % n END AS a FROM g
), p AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), i AS (
  SELECT *, unnest(range(n)) AS i FROM p
), w AS (
  SELECT rid, n, i, words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i
), same AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same
), stretches AS (
  SELECT rid, q, min(i) AS s, max(i) + 1 + q AS e FROM islands GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)
), listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    min({'l': s - e, 's': s, 'q': q}) AS longest
  FROM runs GROUP BY rid
), dropped AS (
  SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(s + q, e)) AS i FROM runs)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, -longest.l AS length, longest.q AS period,
  -longest.l * 1000 // longest.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""
