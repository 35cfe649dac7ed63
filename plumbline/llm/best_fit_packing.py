"""Best-fit packing by hierarchical residual packing.

Texts are tokenized once; only documents longer than a sequence are cut.  Items are dealt into groups of bounded size,
each packed by best fit decreasing.  Nearly full bins are final; underfull bins go on to fewer groups each round and are
packed by best fit again, until one group holds what is left or a round joins nothing.  A bin that is at most half full goes on
as one item; fuller ones could never meet one another, so what they hold goes on piece by piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._storage import cut, table
from ._tokens import PATTERN, broadcast_vocabulary, encoder

CAPACITY = 2048
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The marker that ``tokenizers`` finds in text, and its id.
SPECIAL = (("<|endoftext|>", 50256),)
#: Code points from which on a text is encoded match by match: the encoder's own splitter may overflow its stack on a
#: run of several hundred thousand blanks, and gives the same ids.
LONG = 100_000
#: Items that one group packs, and bins with at most this much room that are final before the last round.
GROUP_ITEMS = 4096
SLACK = 8

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def _long_ids(text: str, bpe) -> np.ndarray:
    """The ids of a text, one match of the pattern after the other; the special markers are no part of any match."""
    known: dict[str, list[int]] = {}
    out: list[int] = []
    marker, marker_id = SPECIAL[0]
    for k, part in enumerate(text.split(marker)):
        if k:
            out.append(marker_id)
        for m in regex.finditer(PATTERN, part):
            piece = m[0]
            ids = known.get(piece)
            if ids is None:
                if len(known) >= 100_000:
                    known.clear()
                ids = known[piece] = bpe._encode_single_piece(piece)
            out += ids
    return np.array(out, "<u4")


def _ids(text: str, bpe) -> np.ndarray:
    if not text:
        return np.empty(0, "<u4")
    if len(text) >= LONG:
        return _long_ids(text, bpe)
    return bpe.encode_to_numpy(text, allowed_special="all").astype("<u4")


def tokenize(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"):
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.  A document's ids are its text's and one
    separator; one longer than ``capacity`` is cut so that its first piece takes the remainder and all others are full.
    """
    vocabulary = broadcast_vocabulary(docs.sparkSession, ranks_path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, SPECIAL)
        out = Writer(_PIECES)
        for doc_id, text in rows(batches, "doc_id", "text"):
            raw = _ids(text, bpe).tobytes() + SEPARATOR.to_bytes(4, "little")
            n, start = len(raw) // 4, 0
            for piece in range(-(-n // capacity)):
                length = (n - 1) % capacity + 1 if piece == 0 else capacity
                crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                yield from out.add((doc_id, piece, start, length, crc))
                start += length
        yield from out.flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes, by best fit decreasing.  Open bins are kept by the room they have left, and the tightest that
    fits is the lowest set bit of a mask."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[i]
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(at)
        mask |= 1 << (room - size)
    return bins


def _repacker(capacity: int, final_room: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one group of items; bins with at most ``final_room`` left are final."""

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        # in the order of the items' numbers, so a rerun packs alike
        pdf = pdf.sort_values("item")
        names, totals, members = (pdf[c].tolist() for c in ("item", "total", "members"))
        out = []
        for chosen in best_fit(totals, capacity):
            inside, at = [], 0
            for i in chosen:
                inside += [{**m, "offset": m["offset"] + at} for m in members[i]]
                at += totals[i]
            out.append((names[chosen[0]], at, inside, capacity - at <= final_room))
        return pd.DataFrame(out, columns=["item", "total", "members", "final"])

    return repack


def _reopened(bins: DataFrame, capacity: int) -> DataFrame:
    """Underfull bins as the items of the next round; each member of a bin over half full is an item of its own."""
    half = F.col("total") * 2 <= capacity
    alone = F.transform(
        "members",
        lambda m: F.struct(
            m["item_"].alias("item"), m["length"].cast("long").alias("total"), F.array(m.withField("offset", F.lit(0).cast("long"))).alias("members")
        ),
    )
    whole = F.array(F.struct("item", "total", "members"))
    return bins.select(F.explode(F.when(half, whole).otherwise(alone)).alias("x")).select("x.*")


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: int = SLACK) -> DataFrame:
    """``items`` (with a ``length``, 0 < length <= capacity) with ``sequence_id`` and ``offset``.

    A round packs groups of about ``group_items`` items; each group is one bounded task.  A bin carries at most
    ``capacity`` members.  Rounds end when a single group packed all that was left, or when a round leaves over 99 % of
    its items (then nothing of use fits any more).  A sequence is named by the item that opened it.  Items of equal length are
    taken in the order of their numbers; repeated rows are items of their own; an empty table gives an empty result.
    """
    own = [c for c in items.columns if c not in ("sequence_id", "offset", "item_")]
    number = F.monotonically_increasing_id()
    # numbered before the cut, so the numbers are fixed from here on
    waiting = cut(items.select(*own, number.alias("item_")))
    waiting = waiting.select(
        F.col("item_").alias("item"),
        F.col("length").cast("long").alias("total"),
        F.array(F.struct(*own, "item_", F.lit(0).cast("long").alias("offset"))).alias("members"),
    )
    members_type = waiting.schema["members"].dataType.simpleString()
    done = [waiting.where(F.col("total") == capacity).select(F.col("item").alias("sequence_id"), "members")]
    waiting = waiting.where(F.col("total") < capacity)
    left, level = waiting.count(), 0
    while left:
        groups = -(-left // group_items)
        dealt = waiting.withColumn("group", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).cast("int"))
        packed = cut(
            dealt.groupBy("group").applyInPandas(
                _repacker(capacity, capacity if groups == 1 else slack), f"item bigint, total bigint, members {members_type}, final boolean"
            )
        )
        done.append(packed.where("final").select(F.col("item").alias("sequence_id"), "members"))
        underfull = packed.where(~F.col("final"))
        waiting = _reopened(underfull, capacity)
        before, left, level = left, waiting.count(), level + 1
        if left > 0.99 * before:
            done.append(underfull.select(F.col("item").alias("sequence_id"), "members"))
            break
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    return bins.select("sequence_id", F.explode("members").alias("m")).select("m.*", "sequence_id").select(
        *own, "sequence_id", "offset"
    )


def pack_documents(
    docs: DataFrame,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are their separator alone, one token.  Repeated rows, and rows that share an id or have none,
    are packed each for itself.  An empty table gives an empty result; further columns are not read.
    """
    path = ranks_path or public_tokenizers.path(VOCABULARY)
    return pack(tokenize(docs, path, capacity, id_col, text_col), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
