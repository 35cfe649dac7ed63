"""Quality by hierarchical empirical Bayes.

A logistic classifier gives each document's own evidence.  Grouped sums of it give the posteriors of hosts and of paths
below them, beta-binomial with moment-estimated strengths, so that sites with few documents are drawn to their host and
hosts with few to the global rate; the posterior odds of a document's site, taken without the document itself, then shift
the document's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import SAMPLE, logistic, sample_labels, share
from ._storage import cut, held_out, table
from .quality_rules import measures

#: Features of the document classifier, as expressions of the measures.
FEATURES = (
    "log1p(n_words)",
    "mean_word_chars",
    "least(symbol_ratio, 3D)",
    "double(symbol_ratio > 0.05)",
    "stop_word_ratio",
    "double(stop_word_ratio > 0.02)",
    "repeat_word_ratio",
    "double(repeat_word_ratio > 0.4)",
    "dup_line_ratio",
    "double(n_words < 20)",
)
#: Bounds of the strength of a prior, in documents.
STRENGTH = (1.0, 1e6)


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: Column, prior: Column) -> float:
    """Documents that a prior weighs: from the spread of group means (over ``n`` documents each) about ``prior``, less
    the spread that means of so few documents have anyway."""
    own = prior * (1 - prior)
    r = groups.agg(
        F.sum(F.col("n") * (mean - prior) ** 2).alias("spread"),
        F.sum(own).alias("chance"),
        F.sum(F.col("n") * own).alias("most"),
    ).first()
    if r["most"] is None or r["most"] <= 0:
        return STRENGTH[1]
    share = (r["spread"] - r["chance"]) / max(r["most"] - r["chance"], 1e-12)
    return float(np.clip(1 / share - 1 if share > 0 else STRENGTH[1], *STRENGTH))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``host, path, n_host, s_host, n_site, s_site`` (documents and their summed probabilities) of every site in
    ``evidence`` (``host, path, p``), the global rate, and the strengths of the global rate over hosts and of hosts over
    their sites.  Sums combine before the shuffle, so a host with a third of all rows is no burden to a task."""
    sites = cut(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    total = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(np.clip(total["s"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    hosts = cut(sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    over_hosts = _strength(hosts, F.col("s") / F.col("n"), F.lit(rate))
    named = hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host"))
    within = cut(
        sites.withColumnsRenamed({"n": "n_site", "s": "s_site"}).join(named, "host").select(
            "host", "path", "n_host", "s_host", "n_site", "s_site"
        )
    )
    prior = (F.lit(over_hosts * rate) + F.col("s_host")) / (over_hosts + F.col("n_host"))
    over_sites = _strength(within.withColumn("n", F.col("n_site")), F.col("s_site") / F.col("n_site"), prior)
    return within, rate, over_hosts, over_sites


def posteriors(rate: float, over_hosts: float, over_sites: float, without: Column) -> tuple[Column, Column]:
    """Host and site posterior of a row with the columns of ``site_sums``, less the evidence ``without`` of one document
    (null: of none)."""
    one, p = F.when(without.isNull(), 0).otherwise(1), F.coalesce(without, F.lit(0.0))
    host = (F.lit(over_hosts * rate) + F.col("s_host") - p) / (F.lit(over_hosts) + F.col("n_host") - one)
    site = (F.lit(over_sites) * host + F.col("s_site") - p) / (F.lit(over_sites) + F.col("n_site") - one)
    return host, site


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """``host, path, n_site, host_posterior, site_posterior`` of every site in ``evidence``, and the global rate."""
    sums, rate, *strengths = site_sums(evidence)
    host, site = posteriors(rate, *strengths, F.lit(None).cast("double"))
    return sums.select("host", "path", "n_site", host.alias("host_posterior"), site.alias("site_posterior")), rate


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, host_posterior, site_posterior`` of every row of ``docs``.

    ``score`` is the probability of good quality, ``evidence`` the classifier's alone, fitted on about ``sample``
    labelled rows (that differ in id or features) outside the held-out fold; the posteriors are those of a document's host and site without the document.
    ``host`` and ``path`` are columns of ``docs``; rows with a null host or
    path form sites of their own.  Null text is empty.  Without labels the evidence is 0.5.  Repeated rows are scored
    alike.  An empty table gives an empty result; further columns are not read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
    )
    measured = cut(
        measures(slim).select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            F.coalesce("host", F.lit("")).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            *[F.expr(f).cast("double").alias(f"f{i}") for i, f in enumerate(FEATURES)],
        )
    )
    # about `sample` rows of two numbers, one for each id; of an id's rows, equal ones are one row with a weight
    chosen = F.broadcast(sample_labels(labels, "quality", sample))
    names = [f"f{i}" for i in range(len(FEATURES))]
    labelled = measured.join(chosen, "doc_id").groupBy("doc_id", "label", *names).agg(F.count("*").alias("n"))
    labelled = labelled.where(share(sample, labelled.count(), "doc_id", *names))
    rows = labelled.groupBy("label", *names).agg(F.sum("n").alias("n")).toPandas()
    if rows["label"].nunique() == 2:
        x, n = rows[names].to_numpy(), rows["n"].to_numpy(float)
        center = np.average(x, axis=0, weights=n)
        scale = np.sqrt(np.average((x - center) ** 2, axis=0, weights=n)) + 1e-9
        w = logistic(np.column_stack([np.ones(len(x)), (x - center) / scale]), rows["label"].to_numpy(float), n)
        slope, constant = w[1:] / scale, w[0] - (w[1:] / scale) @ center
    else:
        slope, constant = np.zeros(len(names)), 0.0
    z = F.lit(float(constant))
    for name, k in zip(names, slope, strict=True):
        z = z + F.col(name) * F.lit(float(k))
    evidence = measured.select("doc_id", "held_out", "host", "path", _sigmoid(z).alias("p"))
    sums, rate, *strengths = site_sums(evidence)
    host, site = posteriors(rate, *strengths, F.col("p"))
    joined = evidence.join(sums, ["host", "path"]).withColumns({"host_posterior": host, "site_posterior": site})
    score = _sigmoid(_logit(F.col("p")) + _logit(F.col("site_posterior")) - float(np.log(rate / (1 - rate))))
    return joined.select(
        "doc_id",
        "held_out",
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.col("p").alias("evidence"),
        "host_posterior",
        "site_posterior",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths the languages below them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
