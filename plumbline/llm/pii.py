"""Personal data: base patterns, and further spans found by weak supervision.

Candidates for further spans come from loose patterns.  Regular-expression, gazetteer and context labelers vote on each
of them; expectation-maximisation over the vote patterns of all documents estimates how reliable the labelers are, and
a logistic span classifier trained on the resulting posteriors decides.  Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import Writer, rows
from ._labels import logistic
from ._storage import table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where its run of digits does; the look-behind spares the other starts
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

#: Loose patterns of further kinds, each with what a text must hold for it (None: a digit).
LOOSE = (
    ("hidden_email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]{1,64}(?:(?:\s?[(\[]\s?dot\s?[)\]]\s?|\.)[A-Za-z0-9-]{1,64})+", re.I), re.compile(r"at\s?[)\]]", re.I)),
    ("local_phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])"), None),
    ("national_id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), None),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), None),
    ("person", re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20}){1,2}(?!\w)"), re.compile("Mr|Ms|Dr|Herr|Frau|Mme|Sr")),
)
#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov io co uk de fr es it nl eu info biz us ca au ch at be".split())
FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica "
    "thomas sarah charles karen anna maria peter hans klaus ursula pierre marie jean claire jose carmen juan ana luis".split()
)
COUNTRIES = frozenset("DE FR ES IT GB NL BE CH AT PT IE LU PL SE NO DK FI".split())
#: Context cues before a span.
CUES = {
    "hidden_email": re.compile(r"mail|contact|reach|write|correo|courriel|kontakt", re.I),
    "local_phone": re.compile(r"phone|call|tel|mobile|cell|fax|dial|text me|teléfono|téléphone|telefon|handy", re.I),
    "national_id": re.compile(r"ssn|social|security|tax\s?id|identi", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "person": re.compile(r"name|dear|sincerely|patient|client|contact|lives|born", re.I),
}
AGAINST = re.compile(r"version|isbn|order|invoice|section|page|fig|chapter|part\s?no|sku|model|=\s?$|[#$€]\s?$", re.I)
LABELERS = 5

_PATTERNS = pa.schema([("kind", pa.string()), ("votes", pa.string()), ("shape", pa.string()), ("n", pa.int64())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())]
)
Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, leftmost and non-overlapping per kind; a match that fails its test is dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _votes(kind: str, text: str, start: int, end: int) -> str:
    """One mark per labeler: + for personal data, - against, 0 for no opinion."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = text[max(0, start - 48) : start]
    if kind == "iban":
        form = "+" if _iban_valid(span) else "-"
    elif kind == "national_id":
        form = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "0"
    elif kind == "local_phone":
        area = span.lstrip("(")
        form = "0" if area[0] in "23456789" else "-"
    else:
        form = "0"
    if kind == "hidden_email":
        listed = "+" if re.split(r"[^a-z0-9-]+", span.lower())[-1] in TOP_DOMAINS else "-"
    elif kind == "person":
        listed = "+" if FIRST_NAMES & {w.lower() for w in span.split()} else "0"
    elif kind == "iban":
        listed = "+" if span[:2] in COUNTRIES else "-"
    else:
        listed = "0"
    cue = "+" if CUES[kind].search(before) else "0"
    against = "-" if AGAINST.search(before) else "0"
    plain = "-" if digits and len(set(digits)) <= 2 else "0"
    return form + listed + cue + against + plain


def _shape(text: str, start: int, end: int) -> str:
    """Coarse features of a span: size class, separators, and what stands next to it."""
    span = text[start:end]
    size = min(len(span) // 8, 4)
    mark = next((c for c in "([-. " if c in span), "_")
    edge = "s" if start == 0 or text[start - 1] == "\n" else "w" if text[start - 1].isspace() else "o"
    return f"{size}{mark}{edge}"


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that ``spans`` cover, in order."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, taken: list[Span]) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, votes, shape) of loose matches that no base span overlaps."""
    out = []
    starts, ends = _covered(taken)
    digit = None
    for kind, pattern, needs in LOOSE:
        if needs is None:
            digit = bool(_DIGIT.search(text)) if digit is None else digit
            if not digit:
                continue
        elif not needs.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            # the last stretch that begins before the match ends
            k = bisect_left(starts, b) - 1
            if k < 0 or ends[k] <= a:
                out.append((kind, a, b, _votes(kind, text, a, b), _shape(text, a, b)))
    return out


@dataclass(frozen=True)
class SpanModel:
    """Probability that a candidate is personal data, by (kind, votes, shape)."""

    reliability: np.ndarray
    probability: dict[tuple[str, str, str], float]

    def accepts(self, kind: str, votes: str, shape: str) -> bool:
        return self.probability.get((kind, votes, shape), 0.0) >= 0.5


def aggregate_votes(marks: list[str], counts: np.ndarray, turns: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: [class, labeler, mark] probabilities, and the posterior of each vote pattern.

    The start takes each labeler to be right four times in five where it votes.
    """
    index = np.array([["-0+".index(c) for c in m] for m in marks])
    rate = np.stack(
        [np.tile([0.4, 0.5, 0.1], (LABELERS, 1)), np.tile([0.1, 0.5, 0.4], (LABELERS, 1))]
    )
    prior, post = 0.5, np.zeros(len(marks))
    prior_rate = rate.copy()
    for _ in range(turns):
        logs = np.log(rate)[:, np.arange(LABELERS), index].sum(axis=2)
        z = logs[1] - logs[0] + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        prior = float(np.clip((counts @ post + 1) / (counts.sum() + 2), 0.01, 0.99))
        for c, weight in enumerate((counts * (1 - post), counts * post)):
            for m in range(3):
                # as many imagined candidates as keep a few real ones from turning a labeler round
                rate[c, :, m] = weight @ (index == m) + 20 * prior_rate[c, :, m]
            rate[c] /= rate[c].sum(axis=1, keepdims=True)
    return rate, post


def fit(docs: DataFrame) -> SpanModel:
    """Fit labeler reliabilities and the span classifier on the candidates of all ``docs`` (``text``).

    The driver sees counts of (kind, vote pattern, shape), of which there is a fixed number, never candidates.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, str], int] = {}
        for (text,) in rows(batches, "text"):
            if text:
                for kind, _, _, votes, shape in candidates(text, base_spans(text)):
                    seen[kind, votes, shape] = seen.get((kind, votes, shape), 0) + 1
        out = Writer(_PATTERNS)
        for key, n in seen.items():
            yield from out.add((*key, n))
        yield from out.flush()

    patterns = (
        docs.select("text")
        .mapInArrow(count, "kind string, votes string, shape string, n long")
        .groupBy("kind", "votes", "shape")
        .agg(F.sum("n").alias("n"))
        .orderBy("kind", "votes", "shape")
        .collect()
    )
    if not patterns:
        return SpanModel(np.zeros((2, LABELERS, 3)), {})
    counts = np.array([r["n"] for r in patterns], float)
    reliability, posterior = aggregate_votes([r["votes"] for r in patterns], counts)
    names = sorted({f for r in patterns for f in _one_hot(r)})
    x = np.array([[1.0, *(float(f in _one_hot(r)) for f in names)] for r in patterns])
    w = logistic(x, posterior, counts)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return SpanModel(reliability, {(r["kind"], r["votes"], r["shape"]): float(v) for r, v in zip(patterns, p, strict=True)})


def _one_hot(r) -> set[str]:
    return {r["kind"], *(f"{i}{v}" for i, v in enumerate(r["votes"])), *(f"s{i}{c}" for i, c in enumerate(r["shape"]))}


def all_spans(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and accepted spans, each by kind (base kinds as listed, then the others) and start."""
    order = {k: i for i, k in enumerate((*KINDS, *(k for k, _, _ in LOOSE)))}
    key = lambda s: (order[s[0]], s[1])
    base = sorted(base_spans(text), key=key)
    more = [(k, a, b) for k, a, b, votes, shape in candidates(text, base) if model.accepts(k, votes, shape)]
    return base, sorted(base + more, key=key)


def _named(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): the counts of base spans, a digest of them, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_FOUND)
        for doc_id, text in rows(batches, "doc_id", "text"):
            base, every = all_spans(text or "", shared.value)
            kinds = [k for k, _, _ in base]
            digest = hashlib.sha256(_named(base).encode()).hexdigest()
            yield from out.add((doc_id, *map(kinds.count, KINDS), digest, _named(every)))
        yield from out.flush()

    return docs.select("doc_id", "text").mapInArrow(
        spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the stretch that they cover is
    replaced once, by the kind of the first."""
    out, at, done = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[at:a], f"[{kind.upper()}]"]
            done = at = b
        elif b > done:
            done = at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; all other columns and null texts stay as they are."""
    model = fit(docs.select(F.col(text_col).alias("text"))) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t is None else redacted(t, all_spans(t, shared.value)[1]) for t in batch.column(at).to_pylist()
            ]
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(texts, type=field.type))

    return docs.mapInArrow(replace, docs.schema)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on and search all ``docs``: one row per row, see :func:`find`.

    Null text is empty: no spans.  Repeated rows are searched each for itself, null ids stay null.  An empty table
    gives an empty result; further columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return find(slim, fit(slim))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
