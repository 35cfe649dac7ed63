"""Advisories on components, and the catalogue of a builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattices import ADVISORY_SEVERITY, CONFIDENCE, POLICY_ACTION, name, rank

#: Kinds of evidence that never confirm, and those that may establish high confidence.
NON_CONFIRMING = ("litigation", "community_report", "forum_report", "social_media_report", "news_report")
TECHNICAL = ("manufacturer_notice", "regulator_notice", "recall", "independent_lab_test", "service_bulletin")


def assess(advisories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Advisories (``id, evidence_ids, policy_action, ...``) with what their active evidence (``id, type, status,
    verification_status`` and any of ``event_key, source_key, publisher, source_id``) supports: ``assessed_status``, ``assessed_confidence``, ``assessed_action``.

    No active evidence withholds any action; only non-confirming kinds cap it at caution; a verified or corroborated
    technical source gives high confidence.
    """
    active = evidence.where((F.col("status") == "active") & ~F.coalesce(F.col("verification_status").isin("retracted", "superseded"), F.lit(False)))
    technical = F.col("verification_status").isin("verified", "corroborated") & F.col("type").isin(*TECHNICAL)
    # what several reports of one event, or of one source, have in common
    names = [c for c in ("event_key", "source_key", "publisher", "source_id") if c in evidence.columns]
    source = F.coalesce(*names) if len(names) > 1 else F.col(names[0])
    links = advisories.select(F.col("id").alias("advisory_id"), F.explode("evidence_ids").alias("id"))
    found = (
        links.join(active, "id")
        .groupBy(F.col("advisory_id").alias("id"))
        .agg(
            F.count("*").alias("active_evidence"),
            F.bool_and(F.col("type").isin(*NON_CONFIRMING)).alias("_weak"),
            F.count_distinct(F.when(technical, source)).alias("independent_sources"),
        )
    )
    out = advisories.join(found, "id", "left")
    n, own = F.coalesce("active_evidence", F.lit(0)), F.col("policy_action")
    weak = F.coalesce("_weak", F.lit(False))
    strong = (n > 0) & ~weak & (F.col("independent_sources") > 0)
    return out.withColumns(
        {
            "active_evidence": n,
            "assessed_status": F.when(strong, F.lit("sufficient")).otherwise(F.lit("needs_review")),
            "assessed_confidence": F.when((n == 0) | weak, F.lit("low")).when(strong, F.lit("high")).otherwise(F.lit("medium")),
            "assessed_action": F.when(n == 0, F.lit("none"))
            .when(weak, F.when(own.isin("none", "inform"), own).otherwise(F.lit("caution")))
            .otherwise(own),
        }
    ).drop("_weak").withColumn("independent_sources", F.coalesce("independent_sources", F.lit(0)))


def evaluate_components(assessed: DataFrame, evaluated_at: Column, stale_days: float, grace_days: float = 0.0) -> DataFrame:
    """Per affected component (``affected_component_ids``): the highest action, severity and confidence, each on its own
    scale, and whether an advisory is stale or due for review.

    A reviewed decision (``reviewed_*`` columns, null where there is none) overrides the assessment; a closed advisory
    has no action.
    """
    status = F.coalesce("reviewed_status", "status")
    action = F.when(status.isin("resolved", "withdrawn", "superseded"), F.lit("none")).otherwise(
        F.coalesce("reviewed_action", "assessed_action")
    )
    days = lambda since: (F.unix_micros(evaluated_at) - F.unix_micros(since)) / 86400e6
    due = days(F.coalesce("next_review_at", "review_after")) >= max(grace_days, 0.0)
    rows = assessed.select(
        F.explode("affected_component_ids").alias("component_id"),
        rank(action, POLICY_ACTION).alias("a"),
        rank(F.coalesce("reviewed_severity", "severity"), ADVISORY_SEVERITY).alias("s"),
        rank(F.coalesce("reviewed_confidence", "assessed_confidence"), CONFIDENCE).alias("c"),
        (days(F.col("updated_at")) > stale_days).alias("stale"),
        F.coalesce(due, F.lit(False)).alias("due"),
    )
    return rows.groupBy("component_id").agg(
        F.count("*").alias("advisories"),
        name(F.max("a"), POLICY_ACTION, "none").alias("policy_action"),
        name(F.max("s"), ADVISORY_SEVERITY, "informational").alias("severity"),
        name(F.max("c"), CONFIDENCE, "low").alias("confidence"),
        F.bool_or("stale").alias("stale"),
        F.bool_or("due").alias("review_due"),
    )


def recommendation_boundary(candidates: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    """Candidates (``engineering_status``) with their effective action; compatible ones are recommended unless excluded
    or suppressed, and suppressed ones stay open to inspection."""
    joined = candidates.join(evaluated.select(F.col("component_id").alias(key), "policy_action"), key, "left")
    fits = F.col("engineering_status") == "compatible"
    return joined.withColumn("policy_action", F.coalesce("policy_action", F.lit("none"))).withColumns(
        {
            "recommended": fits & ~F.col("policy_action").isin("exclude", "suppress_recommendation"),
            "inspectable": fits & (F.col("policy_action") == "suppress_recommendation"),
        }
    )


def catalog_overlay(candidates: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Eligible candidates against a builder's catalogue (``availability, preference``): ``status``, ``reason`` and
    ``rank``.  A missing entry, unavailable and discontinued are ineligible; an unknown availability is unknown."""
    joined = candidates.join(catalog.withColumn("_listed", F.lit(True)), key, "left")
    listed, there = F.coalesce("_listed", F.lit(False)), F.coalesce("availability", F.lit("unknown"))
    status = (
        F.when(~listed | there.isin("unavailable", "discontinued"), F.lit("ineligible"))
        .when(there.isin("stocked", "special_order"), F.lit("eligible"))
        .otherwise(F.lit("unknown"))
    )
    reason = (
        F.when(~listed, F.lit("builder.catalog_missing"))
        .when(there == "unknown", F.lit("builder.availability_unknown"))
        .otherwise(F.concat(F.lit("builder."), there))
    )
    preference = F.coalesce("preference", F.lit("standard"))
    place = (
        F.when(F.col("status") != "eligible", F.lit(999))
        .when(preference == "discouraged", F.lit(5))
        .otherwise(F.when(there == "stocked", F.lit(0)).otherwise(F.lit(2)) + F.when(preference == "preferred", F.lit(0)).otherwise(F.lit(1)))
    )
    return joined.withColumn("status", status).withColumn("reason", reason).withColumn("rank", place).drop("_listed")


def overlay_outcome(overlaid: DataFrame, group: list[str]) -> DataFrame:
    """Per group: eligible if one candidate is, else unknown if one is, else an inventory gap."""
    n = lambda s: F.count_if(F.col("status") == s)
    return overlaid.groupBy(*group).agg(
        F.when(n("eligible") > 0, F.lit("eligible")).when(n("unknown") > 0, F.lit("unknown")).otherwise(F.lit("inventory_gap")).alias("outcome"),
        n("eligible").alias("eligible"),
        F.count("*").alias("candidates"),
    )
