import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import pii, quality_rules


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "pii", "best_fit_packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_clean_documents_pass_the_filters(spark, stages, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = stages[0].join(labels.where("quality = 1 and toxic = 0"), "doc_id")
    long = quality_rules.measures(clean).where("n_words >= 50").select("doc_id")
    lost = long.join(stages[2], "doc_id", "left_anti").count()
    assert lost <= 0.02 * long.count()


def test_one_of_each_group_stays(stages):
    kept = stages[3]
    assert kept.select("text").distinct().count() == kept.count()
    assert kept.join(stages[2], "doc_id", "left_anti").count() == 0
    assert stages[2].select("text").distinct().join(kept.select("text"), "text", "left_anti").count() < 100


def test_personal_data_is_gone(stages):
    assert stages[4].count() == stages[3].count()
    for r in stages[4].collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)


def test_every_kept_document_is_packed(stages):
    packed = stages[5]
    assert packed.select("doc_id").distinct().count() == stages[4].count()
    loads = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert loads.agg(F.max("n")).first()[0] <= 2048


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.columns == stages[5].columns
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def poor(text):
    """Whether a text breaks a quality rule, by plain counting."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 50:
        return True
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    stops = sum(w in quality_rules.STOP_WORDS for w in re.split(r"[^\w]+|[\d_]+", text.lower()))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    mean = sum(map(len, words)) / len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text)) / len(words)
    return len(covered) > 0.5 * len(words) or not 2 <= mean <= 25 or symbols > 0.1 or stops < 0.005 * len(words) or len(lines) - len(set(lines)) > 0.6 * len(lines)


def test_odd_rows_go_through_every_stage(spark, odd, sf_dir, odd_rows):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "score", "kept")
    by_name = dict(corpus_pipeline.STAGES)
    given = sorted(((i, t) for i, t, _ in odd_rows), key=str)
    kept = lambda name: sorted(((r.doc_id, r.text) for r in by_name[name](spark, docs, sf_dir).collect()), key=str)
    # none of them holds what the labelled documents teach to be toxic
    assert kept("toxicity") == given
    assert kept("quality_rules") == [x for x in given if not poor(x[1] or "")]
    assert kept("pii") == given
    # of each group of equal or near texts one row; a text of blanks has no n-gram, a null one is empty
    assert [i for i, _ in kept("ngram_jaccard_join")] == [-3, 1, 10, 2, 4, 5, 6, 6, 7, 9, None]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, t in given:
        pieces[i] += -(-(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) // 2048)
    packed = by_name["best_fit_packing"](spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in packed) == pieces
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
