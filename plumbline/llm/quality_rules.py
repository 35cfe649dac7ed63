"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than blank and tab to carriage return.  All measures cover the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._storage import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Frequent function words of the four languages; a text of any length without them is hardly prose.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from or an "
    "de la le et les des en un du une que est pour qui dans par sur au pas avec "
    "der die und den von zu das mit sich des für auf ist im dem nicht ein eine als "
    "el y los se del las por con no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule where ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Ratios are per word, but dup_line_ratio per line with a word.
RULES = (
    Rule("too_short", "n_words", least=50),
    Rule("repeats_words", "repeat_word_ratio", most=0.5),
    Rule("mean_word_length", "mean_word_chars", least=2.0, most=25.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_word_ratio", least=0.005),
    Rule("repeats_lines", "dup_line_ratio", most=0.6),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.  An array that a lambda function reads by place is best named
    so: as a column, it would be looked up in the row again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows_of(words: Column, high: Column) -> Column:
    """The 3-word windows of a text as sorted longs: the bits of ``high`` are a hash of the words, those below the place
    of the first, so windows with equal words are neighbours."""

    def every(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 3),
            lambda i: F.xxhash64(*[F.get(w, i.cast("int") + k) for k in range(3)]).bitwiseAND(high).bitwiseOR(i),
        )

    return F.when(F.size(words) >= 3, F.sort_array(let(words, every))).otherwise(F.array().cast("array<bigint>"))


def _twins_of(windows: Column, high: Column) -> Column:
    """The places k at which the windows k and k + 1 have the same hash."""

    def found(s: Column) -> Column:
        same = lambda k: F.get(s, k).bitwiseXOR(F.get(s, k + 1)).bitwiseAND(high) == 0
        return F.filter(F.sequence(F.lit(0), F.size(s) - 2), same)

    return F.when(F.size(windows) >= 2, let(windows, found)).otherwise(F.array().cast("array<int>"))


def _place(windows: Column, low: Column, k: Column) -> Column:
    return F.get(windows, k).bitwiseAND(low).cast("int")


def _starts_of(windows: Column, twins: Column, low: Column) -> Column:
    """The places of the windows that have a twin, in order."""
    both = let(windows, lambda s: F.transform(twins, lambda k: F.array(_place(s, low, k), _place(s, low, k + 1))))
    return F.when(F.size(twins) > 0, F.sort_array(F.array_distinct(F.flatten(both)))).otherwise(F.array().cast("array<int>"))


def _repeat_words(words: Column, windows: Column, twins: Column, starts: Column, low: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.  Should windows of different words share a hash, the windows
    of that text are compared by their words instead."""

    def differ(w: Column, s: Column, k: Column) -> Column:
        at, of = _place(s, low, k), _place(s, low, k + 1)
        pairs = [F.get(w, at + j) != F.get(w, of + j) for j in range(3)]
        return pairs[0] | pairs[1] | pairs[2]

    shared = let(words, lambda w: let(windows, lambda s: F.exists(twins, lambda k: differ(w, s, k))))
    # a window covers three words, or those up to the next one
    gap = lambda a: lambda x, j: F.least(F.lit(3), F.coalesce(F.get(a, j + 1) - x, F.lit(3)))
    covered = let(starts, lambda a: F.aggregate(F.transform(a, gap(a)), F.lit(0), lambda s, x: s + x))
    return F.when(F.size(twins) == 0, F.lit(0)).when(shared, _repeat_words_by_sorting(words)).otherwise(covered)


def _repeat_words_by_sorting(words: Column) -> Column:
    """The same by sorting the windows by their words."""
    windows = F.sort_array(
        let(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(*[F.get(w, i + k).alias(f"w{k}") for k in range(3)], i.alias("i")),
            ),
        )
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))

    def covered(s: Column) -> Column:
        # get() of a negative index is null
        found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(windows, covered)


def measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts and ratios that rules speak of; names get ``prefix``.  Null text counts as empty; ratios
    without a word are 0.

    The measures of a row leave through an array of one element, which no filter on them is pushed below: pushed down,
    it would carry copies of the steps that it depends on, nested in each other.
    """
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [f"{p}_{c}" for c in ("words", "lines", "low", "high", "windows", "twins", "starts")]
    words, lines, low, high, windows, twins, starts = map(F.col, own)
    letters = F.split(F.lower(text), r"[^\p{L}]+", -1)
    # one step after the other, so that each array is computed once and carried no further than it is read
    steps = [
        {
            f"{p}_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            f"{p}_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            f"{p}n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
            f"{p}n_stop_words": F.size(F.filter(letters, lambda w: w.isin(STOP_WORDS))).cast("long"),
        },
        {
            f"{p}n_words": F.size(words).cast("long"),
            f"{p}word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)),
            f"{p}n_lines": F.size(lines).cast("long"),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{p}_low": F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words)))) - 1,
        },
        {f"{p}_high": F.bitwise_not(low)},
        {f"{p}_windows": _windows_of(words, high)},
        {f"{p}_twins": _twins_of(windows, high)},
        {f"{p}_starts": _starts_of(windows, twins, low)},
        {f"{p}n_repeat_words": _repeat_words(words, windows, twins, starts, low).cast("long")},
    ]
    counted = docs
    for step in steps:
        counted = counted.withColumns(step)
    found = [c for step in steps for c in step if c not in own]
    carried = [c for c in docs.columns if c not in found]
    counted = counted.select(*carried, F.inline(F.array(F.struct(*found))))

    def ratio(over: str, under: str) -> Column:
        return F.coalesce(F.try_divide(F.col(p + over).cast("double"), F.col(p + under)), F.lit(0.0))

    return counted.withColumns(
        {
            f"{p}mean_word_chars": ratio("word_chars", "n_words"),
            f"{p}symbol_ratio": ratio("n_symbols", "n_words"),
            f"{p}stop_word_ratio": ratio("n_stop_words", "n_words"),
            f"{p}repeat_word_ratio": ratio("n_repeat_words", "n_words"),
            f"{p}dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        }
    )


def broken(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """The names of the rules that a measured row breaks, in table order."""
    checks = []
    for r in rules:
        value = F.col(prefix + r.measure)
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (value < F.lit(r.least))
        if r.most is not None:
            bad = bad | (value > F.lit(r.most))
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with its measures, ``broken_rules`` and ``kept`` (no rule broken), one projection.

    Null text is empty text: no word, hence too short.  Columns of ``docs`` that are named as an output are replaced;
    repeated rows stay; an empty table gives an empty result.
    """
    own = "__m_"
    measured = measures(docs, text_col, own)
    names = [c[len(own) :] for c in measured.columns if c.startswith(own)]
    taken = {*names, "broken_rules", "kept"}
    out = measured.withColumn(f"{own}broken", broken(rules, own))
    return out.select(
        *[c for c in docs.columns if c not in taken],
        *[F.col(own + c).alias(c) for c in names],
        F.col(f"{own}broken").alias("broken_rules"),
        (F.size(f"{own}broken") == 0).alias("kept"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        "kept",
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT rid, doc_id, text,
    list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda w: w IN ({_STOP_SQL})) AS stops
  FROM d
), g AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM s WHERE len(words) >= 3
), h AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM g
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(stops) AS n_stops
  FROM s LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 25 * n_words
    AND n_symbols::DOUBLE / n_words <= 0.1 AND n_stops::DOUBLE / n_words >= 0.005
    AND n_dup_lines::DOUBLE / n_lines <= 0.6 AS kept
FROM b
"""
