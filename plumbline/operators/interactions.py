"""Reviewed interactions held against what is installed: a row per reason, and a verdict that no open question can pass.

All tables have a ``case``, one evaluation each.  A participant of a reviewed relationship is mapped to an installed target; targets,
topologies, qualifiers and configurations meet it in equi-joins on the case, so cases are independent of each other.  ``mappings`` are
those of ``first_mappings``, but for ``participant_reasons``, which sees them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .sequences import first_of

# Codes of reasons by what they do to a verdict.
OPEN = (
    "participant_mapping_ambiguous", "participant_mapping_missing", "participant_component_mismatch", "participant_endpoint_mismatch",
    "participant_target_kind_mismatch", "unresolved_participant", "installed_relationship_missing", "topology_requirement_unknown",
    "configuration_unknown", "required_intermediate_unknown", "unresolved_prerequisite",
)
FAILED = ("installed_relationship_disconnected", "topology_requirement_not_satisfied", "configuration_not_satisfied")
NOT_SHOWN_TO_APPLY = ("applicability_mismatch", "applicability_unknown", "qualifier_conflicting")


def _reasons(df: DataFrame, subject: str, code: Column) -> DataFrame:
    """``case, subject, code`` of the rows whose code is not null."""
    return df.select("case", F.col(subject).cast("string").alias("subject"), code.alias("code")).where(F.col("code").isNotNull())


def first_mappings(mappings: DataFrame) -> DataFrame:
    """The mapping of each participant with the least place; its targets are null where its kind has none."""
    m = first_of(mappings, ["case", "participant"], ["place"]).drop("place")
    at_endpoint = F.col("target_kind") == "interaction_endpoint"
    return m.withColumns(
        {
            "instance": F.when(at_endpoint | (F.col("target_kind") == "component_instance"), F.col("instance")),
            "endpoint": F.when(at_endpoint, F.col("endpoint")),
            "artifact": F.when(F.col("target_kind") == "installed_artifact", F.col("artifact")),
        }
    )


def participant_reasons(participants: DataFrame, mappings: DataFrame, instances: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``case, subject, code`` of participants that are mapped twice, not at all, or to something else than the review names.

    ``participants``: ``case, participant, ref_kind, ref_component, ref_endpoint``; ``mappings``: ``case, participant, place, target_kind,
    instance, endpoint, artifact``; ``instances``: ``case, instance, component``; ``endpoints``: ``component, endpoint`` of the catalogue.
    """
    twice = mappings.groupBy("case", "participant").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    again = twice.select("case", "participant", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))))
    out = _reasons(again, "participant", F.lit("participant_mapping_ambiguous"))
    listed = endpoints.select("component", "endpoint").distinct().withColumn("_listed", F.lit(True))
    rows = (
        participants.join(first_mappings(mappings), ["case", "participant"], "left")
        .join(instances, ["case", "instance"], "left")
        .join(listed, ["component", "endpoint"], "left")
    )
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    at_endpoint = F.coalesce(F.col("target_kind") == "interaction_endpoint", F.lit(False))
    meets = at_endpoint & same("component", "ref_component") & same("endpoint", "ref_endpoint") & F.col("_listed").isNotNull()
    code = (
        F.when(F.col("target_kind").isNull(), "participant_mapping_missing")
        .when(F.col("ref_kind") == "unresolved_external", "unresolved_participant")
        .when(F.col("component").isNull(), "participant_mapping_missing")
        .when((F.col("ref_kind") == "component") & (F.col("target_kind") != "component_instance"), "participant_target_kind_mismatch")
        .when((F.col("ref_kind") == "component") & ~same("component", "ref_component"), "participant_component_mismatch")
        .when((F.col("ref_kind") != "component") & ~meets, "participant_endpoint_mismatch")
    )
    return out.unionByName(_reasons(rows, "participant", code))


def applicability_reasons(applicability: DataFrame, mappings: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """``case, subject, code`` of every condition (``case, applicability, participant, kind, value``): whether the installed qualifiers of
    its participant (``case, instance, endpoint, kind, value``; without an endpoint: of the whole instance) have the reviewed value.
    Several values are conflicting, none or a condition of another kind is unknown."""
    at = mappings.select("case", "participant", "instance", F.col("endpoint").alias("_at"))
    asked = applicability.join(at, ["case", "participant"], "left")
    q = qualifiers.select("case", "instance", "kind", F.col("endpoint").alias("_of"), F.col("value").alias("_has"))
    met = asked.join(q, ["case", "instance", "kind"]).where(F.col("_of").isNull() | (F.col("_of") == F.col("_at")))
    found = met.groupBy("case", "applicability").agg(F.min("_has").alias("_least"), F.max("_has").alias("_most"))
    rows = asked.join(found, ["case", "applicability"], "left")
    vague = (F.col("kind") == "other") | F.col("participant").isNull() | (F.coalesce("value", F.lit("")) == "")
    code = (
        F.when(vague | F.col("_least").isNull(), "applicability_unknown")
        .when(F.col("_least") != F.col("_most"), "qualifier_conflicting")
        .when(F.col("_least") != F.col("value"), "applicability_mismatch")
        .otherwise("applicability_satisfied")
    )
    return _reasons(rows, "applicability", code)


def topology_reasons(relationships: DataFrame, selected: DataFrame, mappings: DataFrame, topologies: DataFrame, ends: DataFrame) -> DataFrame:
    """``case, subject, code`` of the topology selected for each case (``case, form, topology``): connected, disconnected or missing, and
    every mapped component instance that has no end in it.  ``topologies``: ``case, form, topology, state``; ``ends``: ``case, form, topology,
    instance, endpoint``; ``form`` is ``direct`` or ``network``."""
    chosen = selected.join(topologies.select("case", "form", "topology", "state"), ["case", "form", "topology"])
    rows = relationships.select("case").join(chosen, "case", "left")
    code = (
        F.when(F.col("state").isNull(), "installed_relationship_missing")
        .when(F.col("state") == "connected", "installed_relationship_connected")
        .otherwise("installed_relationship_disconnected")
    )
    mapped = mappings.where(F.col("target_kind") == "component_instance").join(chosen, "case")
    apart = mapped.join(ends.select("case", "form", "topology", "instance"), ["case", "form", "topology", "instance"], "left_anti")
    return _reasons(rows, "topology", code).unionByName(_reasons(apart, "participant", F.lit("topology_requirement_unknown")))


def configuration_reasons(prerequisites: DataFrame, mappings: DataFrame, selected: DataFrame, configurations: DataFrame) -> DataFrame:
    """Prerequisites ``case, prerequisite, participant, key, operator, value`` (without a participant: of the selected direct
    relationship) against ``configurations``: ``case, place, key, relationship, instance, endpoint, value``.  Values are JSON text, so a number
    is not its string; of several configurations the one with the least place counts."""
    at = mappings.select("case", "participant", F.col("instance").alias("_i"), F.col("endpoint").alias("_e"))
    direct = selected.where("form = 'direct'").select("case", F.col("topology").alias("_r"))
    asked = prerequisites.join(at, ["case", "participant"], "left").join(direct, "case", "left")
    c = first_of(configurations, ["case", "key", "relationship", "instance", "endpoint"], ["place"]).withColumnRenamed("value", "_has")
    of_pair = F.col("participant").isNull() & (F.col("relationship") == F.col("_r"))
    of_end = F.col("participant").isNotNull() & (F.col("instance") == F.col("_i")) & (F.col("endpoint") == F.col("_e"))
    met = asked.join(c, ["case", "key"]).where(of_pair | of_end)
    best = met.groupBy("case", "prerequisite").agg(F.min(F.struct("place", F.col("_has").alias("has"))).alias("_c"))
    rows = prerequisites.join(best, ["case", "prerequisite"], "left")
    code = (
        F.when(F.col("_c").isNull(), "configuration_unknown")
        .when((F.col("operator") == "present") | F.col("_c.has").eqNullSafe(F.col("value")), "configuration_satisfied")
        .otherwise("configuration_not_satisfied")
    )
    return _reasons(rows, "prerequisite", code)


def intermediate_reasons(
    prerequisites: DataFrame, mappings: DataFrame, instances: DataFrame, artifacts: DataFrame, chosen: DataFrame, topologies: DataFrame, intermediates: DataFrame
) -> DataFrame:
    """Prerequisites ``case, prerequisite, participant``: whether the mapped object is there and is listed as an intermediate
    (``case, form, topology, object``) of the topology chosen for the prerequisite (``case, prerequisite, form, topology``).  A list that lacks it is not
    known to be complete, so nothing is ever refuted."""
    m = mappings.select("case", "participant", "instance", "artifact")
    rows = prerequisites.join(m, ["case", "participant"], "left")
    there = instances.select("case", F.col("instance").alias("object"), F.lit("instance").alias("_what"))
    there = there.unionByName(artifacts.select("case", F.col("artifact").alias("object"), F.lit("artifact").alias("_what"))).distinct()
    rows = rows.withColumns(
        {"object": F.coalesce("artifact", "instance"), "_what": F.when(F.col("artifact").isNotNull(), "artifact").otherwise("instance")}
    )
    held = rows.join(there, ["case", "object", "_what"], "left_semi").join(chosen, ["case", "prerequisite"])
    held = held.join(topologies, ["case", "form", "topology"], "left_semi")
    held = held.join(intermediates, ["case", "form", "topology", "object"], "left_semi").select("case", "prerequisite").distinct()
    out = prerequisites.join(held.withColumn("_held", F.lit(True)), ["case", "prerequisite"], "left")
    code = F.when(F.col("_held").isNotNull(), "required_intermediate_present").otherwise("required_intermediate_unknown")
    return _reasons(out, "prerequisite", code)


def connection_reasons(prerequisites: DataFrame, mappings: DataFrame, chosen: DataFrame, topologies: DataFrame, ends: DataFrame) -> DataFrame:
    """Prerequisites ``case, prerequisite, participant, participant_b, needs`` (``direct``, ``shared_network`` or either): whether the topology
    chosen has both participants as ends, is of the needed form, and is connected."""
    sides = prerequisites.select("case", "prerequisite", F.explode(F.array("participant", "participant_b")).alias("participant"))
    m = mappings.select("case", "participant", "instance", "endpoint")
    at = sides.join(m, ["case", "participant"]).join(chosen, ["case", "prerequisite"])
    e = ends.select("case", "form", "topology", "instance", F.col("endpoint").alias("_end"))
    met = at.join(e, ["case", "form", "topology", "instance"]).where(F.col("endpoint").isNull() | (F.col("endpoint") == F.col("_end")))
    both = met.select("case", "prerequisite", "participant").distinct().groupBy("case", "prerequisite").agg(F.count("*").alias("_n"))
    rows = (
        prerequisites.join(chosen, ["case", "prerequisite"], "left")
        .join(topologies.select("case", "form", "topology", "state"), ["case", "form", "topology"], "left")
        .join(both, ["case", "prerequisite"], "left")
    )
    needed = F.when(F.col("participant") == F.col("participant_b"), 1).otherwise(2)
    wrong = ((F.col("needs") == "direct") & (F.col("form") != "direct")) | ((F.col("needs") == "shared_network") & (F.col("form") != "network"))
    code = (
        F.when(F.col("state").isNull() | wrong | (F.coalesce("_n", F.lit(0)) < needed), "topology_requirement_unknown")
        .when(F.col("state") == "connected", "topology_requirement_satisfied")
        .otherwise("topology_requirement_not_satisfied")
    )
    return _reasons(rows, "prerequisite", code)


def evaluated(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Reasons (``case, subject, code``) and verdicts (``case, status, reasons, open, failed``) of all cases.

    ``t`` has the tables that the functions above describe by their names, ``relationships`` (``case, state, assertion``) and ``prerequisites`` (``case,
    prerequisite, kind, participant, participant_b, needs, key, operator, value``), ``chosen`` and ``selected``.  Prerequisites are looked at only for verified
    relationships with an assertion, all of whose conditions are met.  Such a case is not satisfied if something installed
    contradicts it or the assertion is negative; satisfied if nothing is open; and unknown otherwise, like every other case.
    """
    # these are read by several joins each
    relationships, mappings = t["relationships"], cut(first_mappings(t["mappings"]))
    applies = cut(applicability_reasons(t["applicability"], mappings, t["qualifiers"]))
    said = F.coalesce((F.col("state") == "verified") & F.col("assertion").isNotNull(), F.lit(False))
    review = (
        F.when(F.col("state") == "conflicting", "reviewed_evidence_conflicting")
        .when(~said, "reviewed_assertion_unknown")
        .when(F.col("assertion") == "positive", "reviewed_assertion_positive")
        .otherwise("reviewed_assertion_negative")
    )
    kept_back = applies.where(F.col("code").isin(*NOT_SHOWN_TO_APPLY)).select("case").distinct()
    live = cut(relationships.where(said).join(kept_back, "case", "left_anti").select("case", "assertion"))
    asked = cut(t["prerequisites"].join(live, "case", "left_semi"))
    kind = lambda k: asked.where(F.col("kind") == k)
    parts = [
        participant_reasons(t["participants"], t["mappings"], t["instances"], t["endpoints"]),
        applies,
        _reasons(relationships.withColumn("_none", F.lit(None)), "_none", review),
        topology_reasons(relationships, t["selected"], mappings, t["topologies"], t["ends"]),
        _reasons(kind("other"), "prerequisite", F.lit("unresolved_prerequisite")),
        configuration_reasons(kind("configuration"), mappings, t["selected"], t["configurations"]),
        intermediate_reasons(kind("intermediate"), mappings, t["instances"], t["artifacts"], t["chosen"], t["topologies"], t["intermediates"]),
        connection_reasons(kind("connection"), mappings, t["chosen"], t["topologies"], t["ends"]),
    ]
    reasons = reduce(DataFrame.unionByName, parts)
    code = F.col("code")
    counts = reasons.groupBy("case").agg(
        F.count("*").alias("reasons"), F.count_if(code.isin(*OPEN, *NOT_SHOWN_TO_APPLY[1:])).alias("open"), F.count_if(code.isin(*FAILED)).alias("failed")
    )
    rows = counts.join(live.withColumn("_live", F.lit(True)), "case", "left")
    status = (
        F.when(F.col("_live").isNull(), "unknown").when((F.col("failed") > 0) | (F.col("assertion") == "negative"), "not_satisfied")
        .when(F.col("open") == 0, "satisfied").otherwise("unknown")
    )
    return reasons, rows.select("case", status.alias("status"), "reasons", "open", "failed")


def interpreted(relationships: DataFrame, information: DataFrame, participants: DataFrame, intermediates: DataFrame) -> DataFrame:
    """``relationship, status, reason, unresolved`` of reviewed relationships (``relationship, state, assertion``) by themselves.

    Only verified ones with an assertion say anything.  ``unresolved`` lists, in this order: a missing assertion of a verified one; that
    there is no ``information`` (``relationship, direction``); that some is exposed and none consumed; and required ``intermediates``
    (``relationship, place, ref``) that are no ``participants`` (``relationship, ref``), by place and, at one place, by ref.
    """
    told = information.groupBy("relationship").agg(
        F.bool_or(F.col("direction") == "exposes").alias("_out"), F.bool_or(F.col("direction") == "consumes").alias("_in")
    )
    lost = intermediates.join(participants.select("relationship", "ref"), ["relationship", "ref"], "left_anti")
    lost = lost.groupBy("relationship").agg(F.sort_array(F.collect_list(F.struct("place", "ref"))).alias("_lost"))
    rows = relationships.join(told, "relationship", "left").join(lost, "relationship", "left")
    verified, unsaid = F.coalesce(F.col("state") == "verified", F.lit(False)), F.col("assertion").isNull()
    reason = (
        F.when(~verified, F.concat(F.lit("relationship_"), F.when(F.col("state").isin("provisional", "conflicting"), F.col("state")).otherwise("unresolved")))
        .when(unsaid, "relationship_assertion_missing").when(F.col("assertion") == "negative", "explicit_negative_assertion").otherwise("positive_assertion")
    )
    status = F.when(~verified | unsaid, "unknown").when(F.col("assertion") == "negative", "explicit_negative").otherwise("positive")
    missing = F.transform(F.col("_lost.ref"), lambda r: F.concat(F.lit("required_intermediate_not_in_participants:"), r))
    notes = F.array_compact(
        F.array(
            F.when(verified & unsaid, "relationship_assertion_missing"),
            F.when(F.col("_out").isNull(), "assertion_content_unavailable"),
            F.when(F.col("_out") & ~F.col("_in"), "consumption_not_established"),
        )
    )
    unresolved = F.concat(notes, F.coalesce(missing, F.array().cast("array<string>")))
    return rows.select("relationship", status.alias("status"), reason.alias("reason"), unresolved.alias("unresolved"))
