"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Documents are split into pre-tokens in blocks of bounded text.  A block's documents become sequences of local word
codes (their pre-tokens in order), and its distinct words are exploded with those codes.  The words meet in one shuffle by
word, where each is encoded once; its ids go back to every block that has the word, and the block puts its documents
together by position.  Only distinct words of blocks are shuffled as text, never the running text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._storage import table
from ._tokens import PATTERN, broadcast_vocabulary, encoder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A block is closed by the document that brings it to so many code points.
BLOCK_CHARS = 16 << 20
#: Encoded words that a task holds back to send a block's together.
HELD_WORDS = 1 << 20

_WORDS = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("word", pa.string())])
_CODED = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary())]
)
_IDS = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])


class _Block:
    """Documents of one block.  Its words are coded by falling frequency, then first occurrence; its name is a digest of
    its place (partition, number in it) and of the texts."""

    def __init__(self, partition: int, number: int):
        self.chars = 0
        self.digest = hashlib.blake2b(f"{partition}:{number}".encode(), digest_size=8)
        self.seen: defaultdict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.documents: list[tuple[int, np.ndarray]] = []

    def add(self, split, doc_id: int, text: str) -> None:
        raw = text.encode()
        self.digest.update(len(raw).to_bytes(8, "little"))
        self.digest.update(raw)
        self.documents.append((doc_id, np.array(list(map(self.seen.__getitem__, split(text))), "<u4")))
        self.chars += len(text) + 16

    @property
    def name(self) -> int:
        return int.from_bytes(self.digest.digest(), "little", signed=True)

    def codes(self) -> np.ndarray:
        """Code of each word, in order of first occurrence."""
        counts = np.zeros(len(self.seen), np.int64)
        for _, words in self.documents:
            np.add.at(counts, words, 1)
        out = np.empty(len(counts), "<u4")
        out[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[_Block]:
    split = regex.compile(PATTERN).findall
    partition, number = TaskContext.get().partitionId(), 0
    block = _Block(partition, number)
    for doc_id, text in rows(batches, "doc_id", "text"):
        block.add(split, doc_id, text or "")
        if block.chars >= block_chars:
            yield block
            number += 1
            block = _Block(partition, number)
    if block.chars:
        yield block


def _squeezed(x: np.ndarray) -> bytes:
    """A compressed array of unsigned 32-bit numbers that are mostly small: a byte each, and where that is 255 the number
    itself in three or four byte planes, which compress better than the numbers."""
    x = x.astype("<u4", copy=False)
    large = x[x >= 255]
    planes = np.ascontiguousarray(large.view(np.uint8).reshape(-1, 4).T)
    raw = len(x).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + planes.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unsqueezed(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = raw[8 : 8 + n].astype("<u4")
    planes = raw[8 + n :].reshape(4, -1)
    out[out == 255] = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return out


class _Sender:
    """Holds encoded words back, to send those of a block together."""

    def __init__(self):
        self.held: defaultdict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        self.n = 0

    def add(self, block: np.ndarray, code: np.ndarray, found: list[list[int]]) -> Iterator[pa.RecordBatch]:
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum()))
        order = np.argsort(block, kind="stable")
        ends = np.cumsum(counts)
        for rows_of in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            c = counts[rows_of]
            self.held[int(block[rows_of[0]])].append((code[rows_of], c, _gathered(flat, (ends - counts)[rows_of], c)))
        self.n += len(found)
        if self.n >= HELD_WORDS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        out = Writer(_IDS, size=64)
        for block, parts in self.held.items():
            yield from out.add((block, *(_squeezed(np.concatenate(x)) for x in zip(*parts, strict=True))))
        yield from out.flush()
        self.held.clear()
        self.n = 0


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def encode(
    docs: DataFrame,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, n_tokens, ids`` (binary: little-endian unsigned 32-bit ids) of every whole text, as the rank file's
    encoder gives them without special tokens.

    ``docs`` is read twice, once for the words and once for the order of words, and must give the same rows in the same
    splits both times, as files do; a block is named by its place and content, so rows that moved between the two reads
    end the job with an error instead of a wrong result.  Null and empty texts have no tokens (empty binary).  Repeated rows
    and rows with a null or a repeated id are encoded each for itself.  An empty table gives an empty result; further
    columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = broadcast_vocabulary(spark, ranks_path or public_tokenizers.path(VOCABULARY))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            words, codes, name = list(block.seen), block.codes(), block.name
            for at in range(0, len(words), 20_000):
                part = pa.array(words[at : at + 20_000], pa.string())
                own = codes[at : at + 20_000].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(own), part], schema=_WORDS)

    def order_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_chars):
            out = Writer(_CODED, size=1)
            name, code_of, held, size = block.name, block.codes(), [], 0
            for doc in [*block.documents, None]:
                if doc:
                    held.append(doc)
                    size += len(doc[1])
                if held and (doc is None or size >= 1 << 19):
                    packed = _squeezed(code_of[np.concatenate([c for _, c in held])])
                    yield from out.add((name, [i for i, _ in held], [len(c) for _, c in held], packed))
                    held, size = [], 0

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal words follow each other; each is one match of the pattern, so it is not split again
        bpe = encoder(vocabulary)._encode_single_piece
        out = _Sender()
        last, ids = None, []
        for batch in batches:
            found = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, bpe(word)
                found.append(ids)
            if found:
                yield from out.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), found)
        yield from out.flush()

    def assemble(words: pa.Table, documents: pa.Table) -> pa.Table:
        counts_of = documents["counts"].to_pylist()
        if not counts_of or (words.num_rows == 0 and any(map(sum, counts_of))):
            raise ValueError("the two reads of the documents gave different blocks; write them as a table first")
        code, length_of, flat = (
            np.concatenate([np.empty(0, "<u4"), *map(_unsqueezed, words[c].to_pylist())]) for c in ("codes", "counts", "ids")
        )
        n = int(code.max()) + 1 if len(code) else 0
        start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        start[code], length[code] = np.cumsum(length_of, dtype=np.int64) - length_of, length_of
        out = Writer(_ENCODED, size=1 << 30, weight=1 << 62)
        for ids, counts, packed in zip(documents["ids"].to_pylist(), counts_of, documents["codes"].to_pylist(), strict=True):
            codes, at = _unsqueezed(packed), 0
            for doc_id, count in zip(ids, counts, strict=True):
                own = codes[at : at + count]
                at += count
                tokens = _gathered(flat, start[own], length[own])
                list(out.add((doc_id, len(tokens), tokens.tobytes())))
        return pa.Table.from_batches(list(out.flush()), schema=_ENCODED)

    coded = (
        slim.mapInArrow(words_of, "block long, code int, word string")
        .repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(encode_words, "block long, codes binary, counts binary, ids binary")
    )
    ordered = slim.mapInArrow(order_of, "block long, ids array<long>, counts array<int>, codes binary")
    return (
        coded.groupBy("block")
        .cogroup(ordered.groupBy("block"))
        .applyInArrow(assemble, "doc_id long, n_tokens long, ids binary")
    )


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``encoded`` rows (``doc_id, n_tokens, ids``) with ``bytes``, the concatenated bytes of their tokens.

    The token-byte table has one row per token of the vocabulary, a bound of about 50,000, so it is the broadcast side
    of the join; within a batch the join is one gather.  An id that the table lacks is an error.
    """
    spark = encoded.sparkSession
    vocabulary = broadcast_vocabulary(spark, ranks_path or public_tokenizers.path(VOCABULARY))

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary.value.ranks
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks are expected to count from 0 without gaps")
        length = np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        out = Writer(_DECODED, size=1024, weight=4 << 20)
        for doc_id, n, raw in rows(batches, "doc_id", "n_tokens", "ids"):
            ids = np.frombuffer(raw, "<u4")
            whole = _gathered(flat, start[ids], length[ids]).tobytes()
            yield from out.add((doc_id, n, raw, whole), len(raw) + len(whole))
        yield from out.flush()

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        join_bytes, "doc_id long, n_tokens long, ids binary, bytes binary"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(encoded).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
