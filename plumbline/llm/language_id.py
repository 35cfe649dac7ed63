"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-gram counts of all training texts are summed by Spark; the log-probability matrix, whose size is the number of
languages times a fixed number of buckets and is checked, is broadcast, and batches of texts are scored sparsely with
numpy.
"""

from __future__ import annotations

import functools
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._storage import cut, held_out, table

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Added to every count.
SMOOTHING = 0.5
#: Code points handled at once; a longer text is taken window by window.
RUN = 1 << 18
#: Bytes that the broadcast matrix may have; more languages than fit are an error, never left out.
MOST_BYTES = 256 << 20
#: Languages whose counts a task holds before it gives them out.
HELD_LANGUAGES = 64
UNDETERMINED = "und"

_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


@functools.cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter; to a blank where it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint64)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _buckets(points: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each place, by order; 2**bits where the n-gram holds two blanks in a row."""
    x = _letters()[points]
    gap = (x[1:] == 32) & (x[:-1] == 32)
    out = []
    for order in ORDERS:
        n = len(x) - order + 1
        if n <= 0:
            continue
        with np.errstate(over="ignore"):
            h = np.full(n, order, np.uint64)
            bad = x[:n] == 32 if order == 1 else np.zeros(n, bool)
            for k in range(order):
                h = (h ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if k:
                    bad = bad | gap[k - 1 : k - 1 + n]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        b = (h >> np.uint64(64 - bits)).astype(np.int32)
        b[bad] = 1 << bits
        out.append(b)
    return out


def _windows(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of a text of any length, a window of it at a time.  Windows overlap by two code points, in which no n-gram
    begins, so the n-grams are those of the whole text."""
    # the text stands between two blanks on each side
    padded = f"  {text}  "
    for at in range(0, len(text) + 2, RUN):
        part = padded[at : at + RUN + 2]
        points = np.frombuffer(part.encode("utf-32-le"), "<u4")
        for b in _buckets(points, bits):
            yield b[: len(points) - 2]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with two blanks before each and after the last, so that the n-grams of a text are the
    same wherever it stands; and the place where each begins."""
    points = np.frombuffer("".join([*(f"  {t}" for t in texts), "  "]).encode("utf-32-le"), "<u4")
    lengths = np.array([len(t) + 2 for t in texts])
    return points, np.cumsum(lengths) - lengths


def count_ngrams(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``lang, bucket, n`` over rows with ``text`` and ``lang``; bucket -1 counts texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((1 << bits) + 1, np.int64))
        texts: dict[str, int] = defaultdict(int)
        waiting: dict[str, list[str]] = defaultdict(list)
        held: dict[str, int] = defaultdict(int)

        def settle(lang: str) -> None:
            points, _ = _joined(waiting.pop(lang))
            held.pop(lang)
            for b in _buckets(points, bits):
                counts[lang] += np.bincount(b, minlength=(1 << bits) + 1)

        def given() -> Iterator[pa.RecordBatch]:
            for lang in list(waiting):
                settle(lang)
            for lang, n in texts.items():
                c = counts[lang][: 1 << bits]
                used = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(used) + 1), pa.string()),
                        pa.array(np.append(used, -1).astype(np.int32)),
                        pa.array(np.append(c[used], n)),
                    ],
                    schema=_COUNTS,
                )
            counts.clear()
            texts.clear()

        for lang, text in rows(batches, "lang", "text"):
            if lang not in texts and len(texts) >= HELD_LANGUAGES:
                yield from given()
            texts[lang] += 1
            if len(text) > RUN:
                for b in _windows(text, bits):
                    counts[lang] += np.bincount(b, minlength=(1 << bits) + 1)
                continue
            waiting[lang].append(text)
            held[lang] += len(text) + 2
            if held[lang] >= RUN:
                settle(lang)
        yield from given()

    partial = docs.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Log priors of the languages, and their log probabilities by bucket; the last bucket is of no n-gram and weighs 0."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray

    @property
    def bits(self) -> int:
        return (len(self.weights) - 1).bit_length() - 1


def fit(docs: DataFrame, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING) -> Model:
    """Learns from rows whose ``text`` and ``lang`` are not null.

    Tasks turn the counts of one language each, at most one per bucket, into its log probabilities; the driver puts these
    columns, 256 KB each, side by side, as it has to hold the matrix that it broadcasts.  The number of languages is counted
    first; a matrix of more than ``MOST_BYTES`` is an error.
    """
    counts = cut(count_ngrams(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()), bits))
    texts = {r["lang"]: r["n"] for r in counts.where(F.col("bucket") == -1).limit(MOST_BYTES >> (bits + 2)).collect()}
    langs = sorted(texts)
    if (len(langs) + 1) << (bits + 2) > MOST_BYTES:
        raise ValueError(f"a matrix of {len(langs)} languages or more passes {MOST_BYTES} bytes; use fewer buckets")

    def log_probabilities(cells: pa.Table) -> pa.Table:
        n = np.full(1 << bits, smoothing)
        bucket = cells["bucket"].to_numpy()
        used = bucket >= 0
        n[bucket[used]] += cells["n"].to_numpy()[used]
        column = np.log(n / n.sum()).astype("<f4").tobytes()
        return pa.table({"lang": cells["lang"][:1], "column": pa.array([column], pa.binary())})

    weights = np.zeros(((1 << bits) + 1, len(langs)), np.float32)
    at = {x: k for k, x in enumerate(langs)}
    for r in counts.groupBy("lang").applyInArrow(log_probabilities, "lang string, column binary").toLocalIterator():
        weights[:-1, at[r["lang"]]] = np.frombuffer(r["column"], "<f4")
    prior = np.array([texts[x] for x in langs], float) + smoothing
    return Model(langs, np.log(prior / prior.sum()), weights)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for rows of ``doc_id, held_out, text``: the language of the highest
    posterior, and that posterior.  Null texts and texts without a letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, weights, bits = shared.value.langs, shared.value.prior, shared.value.weights, shared.value.bits
        out = Writer(_SCORES)
        waiting: list[tuple[int, bool, str | None]] = []
        held = 0

        def verdict(doc_id: int, out_of_fit: bool, sums: np.ndarray) -> tuple:
            log = prior + sums
            best = int(log.argmax())
            return doc_id, out_of_fit, names[best], float(1 / np.exp(log - log[best]).sum())

        def settle() -> Iterator[tuple]:
            texts = [t for _, _, t in waiting if t]
            if texts:
                points, begins = _joined(texts)
                sums = np.zeros((len(texts), len(names)))
                for b in _buckets(points, bits):
                    sums += np.add.reduceat(weights[b], np.minimum(begins, len(b) - 1), axis=0, dtype=np.float64)
            at = 0
            for doc_id, out_of_fit, text in waiting:
                if text:
                    yield verdict(doc_id, out_of_fit, sums[at])
                    at += 1
                else:
                    yield doc_id, out_of_fit, UNDETERMINED, 0.0

        for doc_id, out_of_fit, text in rows(batches, "doc_id", "held_out", "text"):
            known = text if text and names and _has_letter(text) else None
            if known and len(known) > RUN:
                sums = np.zeros(len(names))
                for b in _windows(known, bits):
                    # counts of the buckets times their weights, whatever the length of the window
                    found, n = np.unique(b, return_counts=True)
                    sums += n @ weights[found].astype(np.float64)
                yield from out.add(verdict(doc_id, out_of_fit, sums))
                continue
            waiting.append((doc_id, out_of_fit, known))
            held += len(known or "") + 2
            if held >= RUN:
                for row in settle():
                    yield from out.add(row)
                waiting, held = [], 0
        for row in settle():
            yield from out.add(row)
        yield from out.flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        score, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text; learn from texts with a language outside the held-out fold.

    Repeated rows are predicted alike, each for itself; a null id counts as held out.  Without any training row every
    prediction is ``und``.  An empty table gives an empty result; further columns are not read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    return predict(slim.drop("lang"), fit(slim.where(~F.col("held_out")).select("text", "lang")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
