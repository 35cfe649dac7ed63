import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import best_fit_packing as pack
from plumbline.llm import byte_bpe


def tiktoken_encoder(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def multi():
    return tiktoken_encoder("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def json_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_is_tiktoken_and_decode_round_trips(spark, sf_dir, texts, multi):
    got = byte_bpe.op2_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = multi.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 200, 1 << 24])
def test_encode_odd_rows_in_blocks_of_any_size(odd, odd_rows, multi, block):
    got = byte_bpe.decode(byte_bpe.encode(odd, block_chars=block)).collect()
    want = sorted((str(i), tuple(multi.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in odd_rows)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.bytes)) for r in got) == want


LONG_RUNS = [" " * 3_000_000, "\n " * 1_000_000, "a b" + " " * 1_000_000 + "c", "<|endoftext|>" + "\t" * 600_000 + "<|endoftext|>x", "7" * 200_000]


def plain_ids(text, encoder):
    """The ids of each match of the pattern by itself."""
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in encoder._encode_single_piece(m[0])]


def test_long_runs_are_encoded(spark, multi, json_tokenizer):
    df = spark.createDataFrame(list(enumerate(LONG_RUNS)), "doc_id long, text string").repartition(3)
    for r in byte_bpe.decode(byte_bpe.encode(df)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == plain_ids(LONG_RUNS[r.doc_id], multi)
        assert bytes(r.bytes).decode() == LONG_RUNS[r.doc_id]
    pieces = pack.tokenize(df, public_tokenizers.path(pack.VOCABULARY))
    got = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {i: len(json_tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(LONG_RUNS)}


def test_both_ways_of_encoding_agree(texts, json_tokenizer):
    bpe = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken_encoder(pack.VOCABULARY)._mergeable_ranks, special_tokens=dict(pack.SPECIAL)
    )
    for text in [*list(texts.values())[:300], "<|endoftext|><|endoftext|> don't  <|endoftext|", "x\u3000  y\r\n\n z"]:
        ids = json_tokenizer.encode(text, add_special_tokens=False).ids
        assert pack._long_ids(text, bpe).tolist() == pack._ids(text, bpe).tolist() == ids


def test_vocabularies_of_one_size_are_kept_apart(spark):
    from plumbline.llm import _tokens

    names = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
    one, two = (_tokens.encoder(_tokens.broadcast_vocabulary(spark, public_tokenizers.path(n))) for n in names)
    again = _tokens.encoder(_tokens.broadcast_vocabulary(spark, public_tokenizers.path(names[0])))
    assert one is again and one is not two


def test_equal_blocks_in_different_places(spark, multi):
    df = spark.createDataFrame([(k, "the very same words") for k in range(40)], "doc_id long, text string").repartition(4)
    got = byte_bpe.encode(df, block_chars=1).collect()
    assert len(got) == 40 and {r.n_tokens for r in got} == {len(multi.encode_ordinary("the very same words"))}


def test_numbers_survive_squeezing():
    rng = np.random.default_rng(1)
    for x in (np.empty(0, "<u4"), np.array([0, 254, 255, 256, 2**32 - 1], "<u4"), rng.integers(0, 2**20, 5000).astype("<u4")):
        assert (byte_bpe._unsqueezed(byte_bpe._squeezed(x)) == x).all()


def test_empty_tables(none):
    assert byte_bpe.encode(none).count() == 0
    assert pack.pack_documents(none).count() == 0


def check_pieces(rows, texts_of, tokenizer, capacity=2048):
    by_doc, by_bin, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts_of.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert len(pieces) == -(-len(ids) // capacity)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= capacity
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for inside in by_bin.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin), -(-total // capacity)


def test_packing_documents(spark, sf_dir, texts, json_tokenizer):
    bins, bound = check_pieces(pack.op5_best_fit_packing(spark, sf_dir).collect(), texts, json_tokenizer)
    assert bins <= bound * 1.01 + 1


def test_packing_odd_rows(odd, odd_rows, json_tokenizer):
    got = pack.pack_documents(odd).collect()
    unique = {i: t for i, t, _ in odd_rows if i not in (6, 8, None)}
    want = sum(-(-(len(json_tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) // 2048) for _, t, _ in odd_rows)
    assert len(got) == want
    rest = [r for r in got if r.doc_id in unique]
    assert {r.doc_id for r in rest} == set(unique)
    for inside in {r.sequence_id for r in got}:
        rows = sorted((r for r in got if r.sequence_id == inside), key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 2048


def test_rounds_join_what_partitions_left(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 90, 3000).tolist()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i long, length long").repartition(5)
    got = pack.pack(df, capacity=100, group_items=200, slack=0).collect()
    assert sorted(r.i for r in got) == list(range(3000))
    loads = {}
    for r in got:
        loads.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in loads.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 100
    whole = len(pack.best_fit(sizes, 100))
    assert len(loads) <= whole * 1.02 + 2


def test_items_that_never_fit_end_the_rounds(spark):
    df = spark.createDataFrame([(i, 60) for i in range(1000)], "i long, length long")
    assert pack.pack(df, capacity=100, group_items=50).select("sequence_id").distinct().count() == 1000


def test_best_fit_takes_the_tightest_bin():
    bins = pack.best_fit([70, 60, 30, 40, 100], 100)
    assert sorted(map(sorted, bins)) == [[0, 2], [1, 3], [4]]
