"""Toxicity by weak supervision.

A lexicon of words and word beginnings is learned from labelled rows; many lexicon and pattern voters vote
on every document.  A generative label model estimates how often each voter is right, and which voters repeat each
other, from the votes on all documents; a linear classifier is trained on its posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._labels import SAMPLE, sample_labels, share
from ._storage import cut, held_out, table
from .ngram_jaccard_join import shingles

#: Least log odds of entries of the learned lexicon; the share of entries that may be there by chance.
LOG_ODDS = 2.5
CHANCE = 0.1
#: Entries that a lexicon may have, as it is broadcast; more are an error.
MOST_ENTRIES = 1 << 20
#: Voters over the learned lexicon: entries of each kind are dealt to that many voters, the most typical to the first.
FOLDS_OF = {"w": 4, "b4": 2, "b5": 3, "b6": 3, "b7": 2, "b8": 2, "m4": 2, "m5": 2, "m6": 2, "m7": 2}
#: Plain insults of general English, a voter of its own.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown fool foolish "
    "jerk creep garbage filth vermin ugly hate kill shut idiotic imbecile".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_LONG_RUN = re.compile(r"(.)\1{3}")
_SHOUT = re.compile(r"!{2,}")

_SAMPLED = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("text", pa.string())])
_DF = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
_VOTES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("votes", pa.int32()), ("hits", pa.list_(pa.int32()))]
)


def _features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"w:{word}", *(f"b{k}:{word[:k]}" for k in (4, 5, 6, 7, 8) if len(word) > k)]


def _repeats(word: str) -> list[str]:
    """Beginnings that count where words of a text with them occur twice or more."""
    return [f"m{k}:{word[:k]}" for k in (4, 5, 6, 7) if len(word) > k]


def _stretched(text: str) -> bool:
    """Whether a letter stands four times in a row."""
    return any(_LETTER.match(m[1]) for m in _LONG_RUN.finditer(text))


def _words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def _voter_of() -> dict[tuple[str, int], int]:
    voters: dict[tuple[str, int], int] = {}
    for kind, folds in FOLDS_OF.items():
        for fold in range(folds):
            voters[kind, fold] = len(voters)
    return voters


_VOTER_OF = _voter_of()
#: After the learned ones: insults, insults at a reader, two lexicon hits, shouting, stretched letters.
VOTERS = len(_VOTER_OF) + 5


def learn_lexicon(sample: DataFrame) -> list[str]:
    """The features typical of toxic rows of ``sample`` (``doc_id, text, label``), most typical first: those with log odds of at
    least ``LOG_ODDS`` that, at their number of documents, no more than a share ``CHANCE`` would be by chance.

    Near copies would lend their every word the support of many documents, so one row is kept of those that share the
    least n-gram hash.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_SAMPLED)
        for text, label in rows(batches, "text", "label"):
            grams = shingles(text)
            at = int(grams.min().view(np.int64)) if len(grams) else 0
            yield from out.add((at, label, text), len(text))
        yield from out.flush()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in rows(batches, "label", "text"):
            own = counts[label]
            words = _words(text)
            repeats: Counter = Counter()
            for w, n in words.items():
                for f in _repeats(w):
                    repeats[f] += n
            own.update({f for w in words for f in _features(w)})
            own.update(f for f, n in repeats.items() if n > 1)
            own[""] += 1
        clean, toxic = counts
        out = Writer(_DF, size=50_000)
        for feature in clean.keys() | toxic.keys():
            yield from out.add((feature, toxic[feature], clean[feature]))
        yield from out.flush()

    single = (
        sample.mapInArrow(key, "key long, label int, text string")
        .groupBy("key")
        .agg(F.max(F.struct("label", "text")).alias("one"))
        .select("one.label", "one.text")
    )
    found = cut(
        single.mapInArrow(frequencies, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("kind", F.substring_index("feature", ":", 1))
        .withColumn("df", F.col("toxic") + F.col("clean"))
        .where((F.col("df") > 1) | (F.col("feature") == ""))
    )
    totals = found.where(F.col("feature") == "").first()
    if totals is None or not totals["toxic"] or not totals["clean"]:
        return []
    found = found.where(F.col("feature") != "")
    histogram = found.groupBy("kind", "df", "toxic").count().collect()  # no more than the sample's features
    rate = totals["toxic"] / totals["df"]
    least = found.sparkSession.createDataFrame(
        _beyond_chance([tuple(r) for r in histogram], rate), "kind string, df long, least long"
    )
    odds = F.log((F.col("toxic") + 0.1) / (totals["toxic"] + 0.2)) - F.log(
        (F.col("clean") + 0.1) / (totals["clean"] + 0.2)
    )
    chosen = (
        found.join(least, ["kind", "df"])
        .withColumn("odds", odds)
        .where((F.col("odds") >= LOG_ODDS) & (F.col("toxic") >= F.col("least")))
        .select("feature", (F.col("odds") * F.log1p("toxic")).alias("weight"))
    )
    chosen = cut(chosen)
    if (there := chosen.count()) > MOST_ENTRIES:
        raise ValueError(f"a lexicon of {there} entries is too large to broadcast")
    return [r["feature"] for r in chosen.orderBy(F.desc("weight"), "feature").collect()]


def _beyond_chance(histogram: list[tuple[str, int, int, int]], rate: float) -> list[tuple[str, int, int]]:
    """(kind, df, least toxic documents): of the features of that kind and document frequency with as many toxic
    documents, no more than ``CHANCE`` would be expected if toxic documents, a share ``rate`` of all, were drawn blindly.
    Tails are summed in logarithms, so one rule holds at every frequency.
    """
    by: dict[tuple[str, int], dict[int, int]] = {}
    for kind, df, toxic, n in histogram:
        by.setdefault((kind, df), {})[toxic] = n
    most = max((df for _, df in by), default=0)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    found = []
    for (kind, df), counts in by.items():
        t = np.arange(df + 1)
        log = factorial[df] - factorial[t] - factorial[df - t] + t * np.log(rate) + (df - t) * np.log1p(-rate)
        tail = np.exp(np.logaddexp.accumulate(log[::-1])[::-1])
        there, observed, least = sum(counts.values()), 0, None
        for toxic in sorted(counts, reverse=True):
            observed += counts[toxic]
            if toxic and there * tail[toxic] <= CHANCE * observed:
                least = toxic
        if least:
            found.append((kind, df, least))
    return found


def vote(docs: DataFrame, lexicon: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, votes, hits`` for rows of ``doc_id, held_out, text``: one bit per voter, and the places in
    the lexicon of the entries that the text holds.  The binary columns ``keep`` stay beside them."""
    schema = pa.schema([*_VOTES, *[pa.field(c, pa.binary()) for c in keep]])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(shared.value)}
        kinds = [f.split(":", 1)[0] for f in shared.value]
        there, seen, bit = Counter(kinds), Counter(), []
        for kind in kinds:
            bit.append(1 << _VOTER_OF[kind, seen[kind] * FOLDS_OF[kind] // there[kind]])
            seen[kind] += 1
        first = len(_VOTER_OF)
        insult, aimed, twice, shout, stretched = (1 << (first + k) for k in range(5))
        # words looked up so far, and the places in the lexicon of those that have any
        known: set[str] = set()
        hitting: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        out = Writer(schema)
        for doc_id, out_of_fit, text, *kept in rows(batches, "doc_id", "held_out", "text", *keep):
            words = _words(text)
            distinct = set(words)
            new = distinct - known
            if len(known) + len(new) > 1_000_000:
                known, new, hitting = set(), distinct, {}
            known |= new
            for w in new:
                own = tuple(place[f] for f in _features(w) if f in place)
                again = tuple(place[f] for f in _repeats(w) if f in place)
                if own or again:
                    hitting[w] = own, again
            hits: set[int] = set()
            repeats: Counter = Counter()
            for w in distinct & hitting.keys():
                own, again = hitting[w]
                hits.update(own)
                for i in again:
                    repeats[i] += words[w]
            hits.update(i for i, n in repeats.items() if n > 1)
            votes = 0
            for i in hits:
                votes |= bit[i]
            if not INSULTS.isdisjoint(words.keys()):
                votes |= insult | (aimed if "you" in words or "your" in words else 0)
            if len(hits) > 1:
                votes |= twice
            if len(_SHOUT.findall(text)) > 2:
                votes |= shout
            if _stretched(text):
                votes |= stretched
            yield from out.add((doc_id, out_of_fit, votes, sorted(hits), *kept))
        yield from out.flush()

    return docs.select("doc_id", "held_out", "text", *keep).mapInArrow(
        ballots, ", ".join(["doc_id long, held_out boolean, votes int, hits array<int>", *[f"{c} binary" for c in keep]])
    )


def moments(votes: DataFrame) -> tuple[float, np.ndarray]:
    """The number of documents, and how many of them each pair of voters marks (voters by voters), over all rows."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((VOTERS, VOTERS), np.int64), 0
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False)
            x = (bits[:, None] >> np.arange(VOTERS)) & 1
            total += x.T @ x
            n += len(bits)
        if n:
            flat = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "n"]
            )

    summed = votes.select("votes").mapInArrow(products, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(VOTERS * VOTERS + 1)
    for r in summed.collect():
        flat[r["cell"]] = r["n"]
    return flat[-1], flat[:-1].reshape(VOTERS, VOTERS)


class LabelModel:
    """P(votes | toxic): each voter's hit rates in both classes, and a discount for voters that repeat others.

    Votes of two voters that are independent given the class have covariance ``a_i a_j``, where ``a`` is the difference
    of a voter's hit rates times sqrt(prior (1 - prior)).  ``a`` is fitted to all such pairs; pairs that the fit
    leaves with a large correlation of their own are taken as dependent and left out of it, in turns.
    """

    def __init__(self, n: float, pairs: np.ndarray, anchor: np.ndarray, prior: float, turns: int = 20):
        mean = np.diag(pairs) / max(n, 1)
        cov = pairs / max(n, 1) - np.outer(mean, mean)
        scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov))) + 1e-12
        spread = np.sqrt(prior * (1 - prior))
        a = anchor * spread
        away = ~np.eye(len(mean), dtype=bool)
        dependent = np.zeros_like(away)
        for _ in range(turns):
            own = (cov - np.outer(a, a)) / scale
            dependent = (np.abs(own) > 0.2) & away
            use = away & ~dependent
            under = use @ (a**2)
            fitted = np.where(under > 1e-9, ((use * cov) @ a) / np.maximum(under, 1e-9), a)
            a = 0.5 * a + 0.5 * fitted
        delta = np.clip(a / spread, -1, 1)
        eps = 0.5 / max(n, 1) + 1e-6
        self.clean = np.clip(mean - prior * delta, eps, 1 - eps)
        self.toxic = np.clip(self.clean + delta, eps, 1 - eps)
        # within the classes, so that a voter and its copy count as one
        within = np.maximum(np.diag(cov) - a**2, 1e-12)
        own = np.abs(cov - np.outer(a, a)) / np.sqrt(np.outer(within, within))
        self.correlation = np.where(dependent, np.minimum(own, 1), 0)
        self.trust = 1 / (1 + self.correlation.sum(axis=1))
        self.prior = prior

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        x = (votes[:, None] >> np.arange(VOTERS)) & 1
        hit = self.trust * np.log(self.toxic / self.clean)
        miss = self.trust * np.log((1 - self.toxic) / (1 - self.clean))
        log = np.log(self.prior / (1 - self.prior)) + x @ hit + (1 - x) @ miss
        return 1 / (1 + np.exp(-np.clip(log, -30, 30)))


def train_linear(
    hits: list, y: np.ndarray, size: int, n: np.ndarray | None = None, steps: int = 300, l2: float = 1e-5
) -> tuple[float, np.ndarray]:
    """Constant and weights of a logistic regression on the presence of lexicon entries, by Adam over all rows, each of
    which stands for ``n`` (one, if not given)."""
    share_of = np.full(len(hits), 1 / max(len(hits), 1)) if n is None else n / n.sum()
    lengths = np.array([len(h) for h in hits])
    column = np.concatenate([np.asarray(h, np.int64) for h in hits]) if lengths.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(hits)), lengths)
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[column], len(hits))
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share_of
        g = np.append(np.bincount(column, gap[row], size), gap.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[-1]), w[:-1]


def _linear_scores(voted: DataFrame, constant: float, weights: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """``voted`` with the classifier's ``score`` of its ``hits``; the weights are broadcast."""
    shared = voted.sparkSession.sparkContext.broadcast(weights)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, hits = batch.columns
            flat = hits.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(hits.offsets.to_numpy())
            row = np.repeat(np.arange(len(hits)), lengths)
            z = constant + np.bincount(row, shared.value[flat], len(hits))
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([*others, score], names=[*batch.schema.names[:-1], "score"])

    binary = "".join(f", {c} binary" for c in keep)
    return voted.select("doc_id", "held_out", *keep, "hits").mapInArrow(
        scores, f"doc_id long, held_out boolean{binary}, score double"
    )


def score(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; score is the probability of the label 1.

    The lexicon is fitted on the rows of about ``sample`` labelled ids, the classifier on about ``sample`` rows that differ in id, votes
    or hits, none of them held out; the label model on the votes on all documents.  Null text is empty and, like any text without an entry of the lexicon, has the score of the
    classifier's constant.  Without labels, or without toxic ones, every score is 0.  Repeated rows are scored alike; a
    null id counts as held out.  An empty table gives an empty result; further columns are not read, but the binary ones named by
    ``keep`` follow ``doc_id, held_out``.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *keep,
    )
    # about `sample` rows of two numbers, one for each id
    chosen = F.broadcast(cut(sample_labels(labels, "toxic", sample)))
    lexicon = learn_lexicon(slim.join(chosen, "doc_id").select("doc_id", "text", "label"))
    voted = cut(vote(slim, lexicon, keep))

    rates = (
        voted.join(chosen, "doc_id")
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(F.shiftright("votes", i).bitwiseAND(F.lit(1))).alias(f"v{i}") for i in range(VOTERS)],
        )
        .collect()
    )
    by_label = {r["label"]: (r["n"], np.array([r[f"v{i}"] for i in range(VOTERS)], float)) for r in rates}
    if not by_label.get(1) or not by_label.get(0) or not lexicon:
        return voted.select("doc_id", "held_out", *keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    (n1, hits1), (n0, hits0) = by_label[1], by_label[0]
    n, pairs = moments(voted)
    model = LabelModel(n, pairs, hits1 / n1 - hits0 / n0, min(max(n1 / (n1 + n0), 1e-3), 0.5))

    fold = voted.where(~F.col("held_out"))
    # repeated rows go or stay together and are one row with a weight, so that about `sample` rows reach the driver
    key = ("doc_id", "votes", "hits")
    there = fold.agg(F.approx_count_distinct(F.xxhash64(*key), 0.02).alias("n")).first()["n"]
    kept = fold.where(share(sample, there, *key)).groupBy("votes", "hits").agg(F.count("*").alias("n")).toPandas()
    posterior = model.posterior(kept["votes"].to_numpy())
    constant, weights = train_linear(kept["hits"].tolist(), posterior, len(lexicon), kept["n"].to_numpy(float))
    return _linear_scores(voted, constant, weights, keep).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
