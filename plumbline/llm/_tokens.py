"""Byte-level BPE vocabularies from rank files, as broadcast values that tasks turn into encoders."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import public_tokenizers
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

PATTERN = public_tokenizers.PATTERN
#: Code points from which on a text is encoded match by match: the encoder's own splitter may overflow its stack on a long run.
LONG = 100_000
_encoders: dict[tuple, tiktoken.Encoding] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes to rank, and the digest of the file they come from."""

    digest: str
    ranks: dict[bytes, int]


def read_vocabulary(path: str) -> Vocabulary:
    """From a file of lines with base64 bytes and a rank.  Vocabularies are bounded files of about 50,000 tokens, read on
    the driver and broadcast."""
    with open(path, "rb") as file:
        raw = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return Vocabulary(hashlib.sha256(raw).hexdigest(), ranks)


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encoder(vocabulary: Broadcast, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The encoder of a broadcast vocabulary, built once a worker."""
    key = (vocabulary.value.digest, special)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=vocabulary.value.ranks, special_tokens=dict(special)
        )
    return _encoders[key]


def ordinary_ids(text: str, bpe: tiktoken.Encoding) -> list[int]:
    """The ids of a text of any length, each match of the pattern separately; control strings are ordinary text."""
    if len(text) < LONG:
        return bpe.encode_ordinary(text)
    return [i for m in regex.finditer(PATTERN, text) for i in bpe._encode_single_piece(m[0])]
