"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared by pruned Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._storage import cut, table
from .quality_rules import STOP_WORDS, let

#: Common words that open a signature.
ANCHORS = tuple(dict.fromkeys(STOP_WORDS))
#: Content words in a chain, and the words after an anchor among which they are sought.
CHAIN = 2
REACH = 8


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The sorted distinct signature hashes (array of int) of a whole text.

    Words are lower-case runs of letters, marks and digits.  Each anchor word opens one signature: itself and the
    first ``chain`` words that are no anchors among the ``reach`` words after it, or as many as there are.  A text with
    words but no anchor has the chains that open at its every word; a text without words (or null) has no signature.
    """
    words = F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: F.length(w) > 0
    )

    def chain_at(w: Column, i: Column) -> Column:
        content = F.filter(F.slice(w, i + 2, reach), lambda x: ~x.isin(*anchors))
        return F.hash(F.get(w, i), *[F.get(content, F.lit(k)) for k in range(chain)])

    def spots(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(*anchors))
        every = F.sequence(F.lit(0), F.size(w) - 1)
        return let(at, lambda a: F.transform(F.when(F.size(a) > 0, a).otherwise(every), lambda i: chain_at(w, i)))

    none = F.array().cast("array<int>")
    return let(words, lambda w: F.when(F.size(w) == 0, none).otherwise(F.sort_array(F.array_distinct(spots(w)))))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets.  Pairs whose sizes alone keep them below ``at_least`` are pruned to 0
    without being compared.  Two empty sets are alike (1); an empty and another set are not (0)."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    jaccard = common / (F.size(a) + F.size(b) - common)
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small < large * at_least), F.lit(0.0))
        .otherwise(jaccard.cast("double"))
    )


def as_string(signature: Column) -> Column:
    """A fingerprint as text: its length partition, then its signatures in hexadecimal."""
    return F.concat_ws(
        ":", F.size(signature).cast("string"), F.concat_ws(",", F.transform(signature, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    )


def similar_pairs(sets: DataFrame, id_col: str = "doc_id", sig_col: str = "signatures", at_least: float = 0.8):
    """Pairs ``(a, b, likeness)`` of different signature sets with a likeness of ``at_least``; ``a < b`` are the least
    ids of rows that have each set, so that copies are never expanded.

    Sets are partitioned by length: bucket k holds sizes from ``at_least**-k`` on, so similar sets lie in the same or in
    neighbouring buckets.  Within them, sets meet on their rarest signatures only: a pair with enough overlap shares one of
    the first ``n - ceil(at_least * n) + 1`` in any common order, here by rising number of sets that have a signature, then
    by hash.  So a passage in very many texts brings together only texts that hold little else.  Each candidate is
    compared once; where a signature is still common, adaptive execution splits its join.  Empty and null sets have no pairs.
    """
    classes = (
        sets.where(F.size(sig_col) > 0)
        .groupBy(F.col(sig_col).alias("s"))
        .agg(F.min(id_col).alias("id"))
        .withColumn("n", F.size("s"))
    )
    classes = cut(classes)
    bucket = F.floor(F.log(F.col("n")) / -F.log(F.lit(at_least)) + 1e-9)
    kept = (F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1).cast("int")
    each = classes.select("id", "n", F.explode("s").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df"))
    ranked = each.join(common, "h").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "h")))
    heads = cut(ranked.where(F.col("k") <= kept).select("id", "n", bucket.alias("bucket"), "h"))
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "h", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h", "bucket")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = (
        left.join(right, ["h", "bucket"])
        .where(ordered & (F.col("na") >= F.col("nb") * at_least - 1e-9))
        .select("a", "b")
        .distinct()
    )
    sig = classes.select("id", "s")
    compared = (
        pairs.join(sig.toDF("a", "sa"), "a")
        .join(sig.toDF("b", "sb"), "b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness("sa", "sb", at_least).alias("likeness"))
    )
    return compared.where(F.col("likeness") >= at_least)


def followers(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, next_id)`` over the distinct ids in ascending order; the last is followed by the first.

    Ids are range-partitioned and numbered in order; the successor within a partition is one number on, and only the
    first id of each partition meets the driver's single small window.
    """
    ids = docs.select(F.col(id_col).alias("id")).where(F.col(id_col).isNotNull()).distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        ids.repartitionByRange(n, "id")
        .sortWithinPartitions("id")
        .select("id", F.monotonically_increasing_id().alias("pos"))
    )
    edges = placed.groupBy(F.shiftright("pos", 33).alias("part")).agg(
        F.min("id").alias("first_id"), F.max("pos").alias("last_pos")
    )
    everywhere = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = edges.select(
        "last_pos",
        F.coalesce(F.lead("first_id").over(Window.orderBy("part")), F.first("first_id").over(everywhere)).alias("jump"),
    )
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("step"))
    return (
        placed.join(after, "pos", "left")
        .join(over, F.col("pos") == F.col("last_pos"), "left")
        .select("id", F.coalesce("step", "jump").alias("next_id"))
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its text edited by its successor's, the signature sets of both, and their likenesses.

    The edited text keeps all but the last floor(n/2) code points and takes as many (or all) from the start of the next
    document, in ascending id; after the last comes the first.  Where rows share an id, each keeps its own row, and of their
    texts that with the least such start, then the least signatures, stands for "next"; a document without another is its own next.  Null text is empty; rows with a
    null id are edited with nothing and have a null ``near_next``.  An empty table gives an empty result.
    """
    every = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # both joins below read this same table by id, so its texts are shuffled once
    own = every.where(F.col("id").isNotNull())
    wants = own.groupBy("id").agg(F.max(F.length("text")).alias("most")).join(followers(own.select("id"), "id"), "id")
    wants = wants.select(
        F.col("id").alias("want_id"), F.col("next_id").alias("id"), F.floor(F.col("most") / 2).cast("int").alias("half")
    )
    giving = own.join(wants, "id").select(
        F.col("want_id").alias("id"),
        F.struct(F.left("text", F.col("half")).alias("head"), signatures(F.col("text")).alias("sigs")).alias("given"),
    )
    giving = giving.groupBy("id").agg(F.min("given").alias("given"))
    alone = every.where(F.col("id").isNull()).withColumn("given", F.lit(None).cast(giving.schema["given"].dataType))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("given.head", F.lit("")), half))
    both = own.join(giving, "id").unionByName(alone).select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited"),
        signatures(F.col("text")).alias("signatures"),
        F.col("given.sigs").alias("next_signatures"),
    )
    both = both.withColumn("edited_signatures", signatures(F.col("edited")))
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.col("edited").alias("edited_text"),
        "signatures",
        "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("signatures")).alias("fingerprint"),
        as_string(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
