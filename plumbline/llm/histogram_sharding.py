"""Byte-balanced sharding by histogram sort.

Rows are ordered by a hash of their text, their id, and a number of the row, so equal texts are neighbours and no two
rows are equal.  The boundaries between shards are found by probing: each round counts, in one map-side combined
aggregation, the exact bytes below 256 evenly spaced candidate keys inside every interval that still holds an unsettled
boundary, and narrows the interval to the candidate that brackets its target.  Once all boundaries meet the tolerance,
rows move once, to sorted partitions of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._storage import cut, table

#: Bits that one round of probes resolves: 2**8 candidates in every open interval.
PROBE_BITS = 8
#: The parts of a key, longs in signed order: hash of the text, id, number of the row.
KEY = ("key_text", "key_id", "key_row")
KEY_BITS = 64 * len(KEY)
#: Bits that all rows of one text share.
TEXT_BITS = 64
SIGN = -(1 << 63)
#: Bytes of text that one task sorts, about.
TASK_BYTES = 64 << 20
#: The table of where shards begin in partitions is broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 1 << 20


@dataclass
class _Open:
    """A boundary still being searched: the key prefix that holds it, and the exact bytes below that prefix."""

    index: int
    target: float
    prefix: int = 0
    below: int = 0


def _signed(x: int) -> int:
    return x - (1 << 63)


def _unsigned_digits(column: Column, bits: int) -> Column:
    """The leading ``bits`` of a long in signed order, as an unsigned number."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(SIGN)), 64 - bits)


def _prefix(bits: int) -> Column:
    """The leading ``bits`` of the key, as text: its parts' leading digits, those past ``bits`` left out."""
    parts = [_unsigned_digits(F.col(c), min(bits - 64 * k, 64)).cast("string") for k, c in enumerate(KEY) if bits > 64 * k]
    return F.concat_ws(":", F.lit("k"), *parts)


def _prefix_name(prefix: int, bits: int) -> str:
    """The same of a number."""
    parts = []
    while bits:
        own = (bits - 1) % 64 + 1
        x = prefix & ((1 << own) - 1)
        parts.append(str(x - (1 << 64) if x >= 1 << 63 else x))
        prefix, bits = prefix >> own, bits - own
    return ":".join(["k", *reversed(parts)])


def _digit(bits: int) -> Column:
    """The ``PROBE_BITS`` after the leading ``bits``."""
    part, used = divmod(bits, 64)
    return _unsigned_digits(F.col(KEY[part]), used + PROBE_BITS).bitwiseAND(F.lit((1 << PROBE_BITS) - 1)).cast("int")


def find_splitters(keyed: DataFrame, targets: list[float], tolerance: float, whole: float = 0.0) -> list[int]:
    """Boundary keys, one per target: the bytes of rows below a boundary differ from its target by at most
    ``tolerance``, or by less than the row at the boundary where one row alone is larger than that.  With ``whole``,
    a boundary inside a run of equal texts moves to the nearer end of it if that is at most ``whole`` bytes, or one
    of its rows, away.

    ``keyed`` has the columns of ``KEY`` and ``weight``.  The driver sees at most 256 counts per open boundary and round,
    whatever the number of rows.
    """
    found: dict[int, int] = {}
    still = [_Open(i, t) for i, t in enumerate(targets)]
    bits = 0
    while still:
        names = {_prefix_name(o.prefix, bits): o.prefix for o in still}
        rows = keyed if bits == 0 else keyed.where(_prefix(bits).isin(list(names)))
        counts: dict[int, list[tuple[int, int, int]]] = {}
        for r in (
            rows.groupBy(_prefix(bits).alias("prefix"), _digit(bits).alias("digit"))
            .agg(F.sum("weight").alias("bytes"), F.count("*").alias("n"))
            .collect()
        ):
            counts.setdefault(names.get(r["prefix"], 0), []).append((r["digit"], r["bytes"], r["n"]))
        bits += PROBE_BITS
        narrowed = []
        for o in still:
            below = o.below
            digits = sorted(counts.get(o.prefix, []))
            for at, (digit, size, n) in enumerate(digits):
                if below + size >= o.target or at == len(digits) - 1:
                    break
                below += size
            else:
                found[o.index] = 0
                continue
            prefix = (o.prefix << PROBE_BITS) | digit
            low, high = abs(o.target - below), abs(below + size - o.target)
            together = whole and bits == TEXT_BITS and min(low, high) <= max(whole, size / n)
            if min(low, high) <= tolerance or n == 1 or bits == KEY_BITS or together:
                found[o.index] = (prefix + (high < low)) << (KEY_BITS - bits)
            else:
                narrowed.append(_Open(o.index, o.target, prefix, below))
        still = narrowed
    return [found[i] for i in range(len(targets))]


def _shard_of(splitters: list[int], first: int = 0) -> Column:
    """The number of boundaries at or below the row's key, as a balanced decision tree."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    at = splitters[mid]
    if at >= 1 << KEY_BITS:
        below = F.lit(True)
    else:
        below = F.lit(False)
        for k, c in reversed(list(enumerate(KEY))):
            part = F.lit(_signed(at >> (KEY_BITS - 64 * (k + 1)) & ((1 << 64) - 1)))
            below = (F.col(c) < part) | ((F.col(c) == part) & below)
    return F.when(below, _shard_of(splitters[:mid], first)).otherwise(_shard_of(splitters[mid + 1 :], first + mid + 1))


def shard(
    docs: DataFrame,
    num_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 1e-4,
    whole: float = 5e-3,
    slices_per_shard: int | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` (0 to ``num_shards`` - 1) and ``slot`` (gapless from 0).

    A row's size is the UTF-8 bytes of its text plus 16; shards differ from the mean by ``tolerance`` of it, or by part
    of the row at the boundary.  Equal texts stay in one shard where that moves the boundary by at most ``whole`` of
    the mean or by one row; a larger group fills a run of shards.  Rows are sorted in ``slices_per_shard`` tasks a shard
    (default: tasks of about 64 MB of text each), whose bounds Spark draws through shards and runs of equal texts alike.

    A null text has size 16 and sorts as the empty text, a null id first within its text.  Repeated rows stay and get
    slots of their own, and a run of them is split like any other.  An empty table gives an empty result.  The columns
    ``carry`` (all by default) go along and are checkpointed with the keys; those named as an output are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    outputs = ("size", "text_crc32", "shard", "slot")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in outputs]
    own = "__s_"
    keyed = docs.select(
        *[F.col(c).alias(f"{own}{k}") for k, c in enumerate(carried)],
        (F.octet_length(text).cast("long") + 16).alias("weight"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key_text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(SIGN)).alias("key_id"),
        # numbered before the cut, so the numbers are fixed from here on
        F.monotonically_increasing_id().alias("key_row"),
    )
    keyed = cut(keyed)
    total = keyed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    targets = [total * k / num_shards for k in range(1, num_shards)]
    splitters = find_splitters(keyed, targets, tolerance * total / num_shards, whole * total / num_shards) if total else []

    tasks = num_shards * slices_per_shard if slices_per_shard else max(num_shards, -(-total // TASK_BYTES))
    placed = cut(
        keyed.withColumn("shard", _shard_of(splitters))
        .repartitionByRange(tasks, *KEY)
        .sortWithinPartitions(*KEY)
        .withColumn("pos", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("pos", 33))
    )
    # one row for each partition and each boundary within one; a shard begins in a partition where others end
    runs = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    if tasks + num_shards <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return placed.join(starts, ["shard", "part"]).select(
        *[F.col(f"{own}{k}").alias(c) for k, c in enumerate(carried)],
        F.col("weight").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("pos") - F.col("first") + F.col("earlier")).alias("slot"),
    )


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
