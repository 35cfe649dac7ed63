"""Interactions of hand-made cases, each with one thing wrong."""

import pytest

from plumbline.operators import interactions

SCHEMAS = {
    "relationships": "case long, state string, assertion string",
    "participants": "case long, participant string, ref_kind string, ref_component string, ref_endpoint string",
    "mappings": "case long, participant string, place int, target_kind string, instance string, endpoint string, artifact string",
    "instances": "case long, instance string, component string",
    "endpoints": "component string, endpoint string",
    "artifacts": "case long, artifact string",
    "applicability": "case long, applicability string, participant string, kind string, value string",
    "qualifiers": "case long, instance string, endpoint string, kind string, value string",
    "topologies": "case long, form string, topology string, state string",
    "ends": "case long, form string, topology string, instance string, endpoint string",
    "intermediates": "case long, form string, topology string, object string",
    "selected": "case long, form string, topology string",
    "chosen": "case long, prerequisite string, form string, topology string",
    "prerequisites": "case long, prerequisite string, kind string, participant string, participant_b string, needs string, key string, operator string, value string",
    "configurations": "case long, place int, key string, relationship string, instance string, endpoint string, value string",
}
#: A case that is satisfied, without its case number.
GOOD = {
    "relationships": [("verified", "positive")],
    "participants": [("inverter", "component", "inv", None), ("bus", "interaction_endpoint", "bat", "can")],
    "mappings": [("inverter", 0, "component_instance", "i1", None, None), ("bus", 0, "interaction_endpoint", "b1", "can", None), ("hub", 0, "installed_artifact", None, None, "hub1")],
    "instances": [("i1", "inv"), ("b1", "bat")],
    "artifacts": [("hub1",)],
    "applicability": [("fw", "inverter", "firmware", "2.1")],
    "qualifiers": [("i1", None, "firmware", "2.1")],
    "topologies": [("direct", "d", "connected")],
    "ends": [("direct", "d", "i1", "can"), ("direct", "d", "b1", "can")],
    "intermediates": [("direct", "d", "hub1")],
    "selected": [("direct", "d")],
    "chosen": [("link", "direct", "d"), ("via", "direct", "d")],
    "prerequisites": [
        ("link", "connection", "inverter", "bus", "direct", None, None, None), ("via", "intermediate", "hub", None, None, None, None, None),
        ("baud", "configuration", "bus", None, None, "baud", "equals", "500"), ("on", "configuration", None, None, None, "on", "present", None),
    ],
    "configurations": [(0, "baud", None, "b1", "can", "500"), (1, "baud", None, "b1", "can", "250"), (0, "on", "d", None, None, "null")],
}
LINK, VIA, BAUD, ON = GOOD["prerequisites"]
#: What is changed, the status then, and the codes that are there then and not in the good case.
CASES = [
    ({}, "satisfied", set()),
    ({"relationships": [("verified", "negative")]}, "not_satisfied", {"reviewed_assertion_negative"}),
    ({"relationships": [("conflicting", "positive")]}, "unknown", {"reviewed_evidence_conflicting"}),
    ({"relationships": [("verified", None)]}, "unknown", {"reviewed_assertion_unknown"}),
    ({"mappings": GOOD["mappings"][1:]}, "unknown", {"participant_mapping_missing", "applicability_unknown"}),
    ({"mappings": GOOD["mappings"] + [("hub", 1, "component_instance", "i1", None, None)]}, "unknown", {"participant_mapping_ambiguous"}),
    ({"instances": [("i1", "other"), ("b1", "bat")]}, "unknown", {"participant_component_mismatch"}),
    ({"participants": [("bus", "interaction_endpoint", "bat", "rs485")]}, "unknown", {"participant_endpoint_mismatch"}),
    ({"participants": [("bus", "component", "bat", None)]}, "unknown", {"participant_target_kind_mismatch"}),
    ({"participants": [("bus", "unresolved_external", None, None)]}, "unknown", {"unresolved_participant"}),
    ({"qualifiers": [("i1", None, "firmware", "2.0")]}, "unknown", {"applicability_mismatch"}),
    ({"qualifiers": [("i1", None, "firmware", "2.1"), ("i1", None, "firmware", "2.2")]}, "unknown", {"qualifier_conflicting"}),
    ({"qualifiers": [("i1", "can", "firmware", "2.1")]}, "unknown", {"applicability_unknown"}),
    ({"applicability": [("fw", "inverter", "other", "x")]}, "unknown", {"applicability_unknown"}),
    ({"topologies": [("direct", "d", "disconnected")]}, "not_satisfied", {"installed_relationship_disconnected", "topology_requirement_not_satisfied"}),
    ({"topologies": []}, "unknown", {"installed_relationship_missing", "topology_requirement_unknown", "required_intermediate_unknown"}),
    ({"ends": [("direct", "d", "b1", "can")]}, "unknown", {"topology_requirement_unknown"}),
    ({"prerequisites": [(*LINK[:4], "shared_network", *LINK[5:])]}, "unknown", {"topology_requirement_unknown"}),
    ({"prerequisites": [(*BAUD[:7], '"500"')]}, "not_satisfied", {"configuration_not_satisfied"}),
    ({"prerequisites": [(*ON[:5], "off", *ON[6:])]}, "unknown", {"configuration_unknown"}),
    ({"prerequisites": [("odd", "other", None, None, None, None, None, None)]}, "unknown", {"unresolved_prerequisite"}),
    ({"intermediates": []}, "unknown", {"required_intermediate_unknown"}),
    ({"artifacts": []}, "unknown", {"required_intermediate_unknown"}),
    ({"mappings": GOOD["mappings"][:2]}, "unknown", {"required_intermediate_unknown"}),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = {name: [] for name in SCHEMAS}
    for case, (change, _, _) in enumerate(CASES):
        for name, given in (GOOD | change).items():
            rows[name] += [(case, *r) for r in given]
    rows["endpoints"] = [("bat", "can"), ("bat", "can"), ("inv", "can")]
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def test_one_change_each(tables):
    reasons, verdicts = interactions.evaluated(tables)
    codes = {}
    for r in reasons.collect():
        codes.setdefault(r.case, []).append((r.subject, r.code))
    got = {r.case: r for r in verdicts.collect()}
    assert len(codes[0]) == len(set(codes[0])) == 7
    good = {c for _, c in codes[0]}
    for case, (change, status, new) in enumerate(CASES):
        assert got[case].status == status, change
        assert {c for _, c in codes[case]} - good == new, change
        assert got[case].reasons == len(codes[case])
    assert got[0].open == got[0].failed == 0


def test_no_cases(tables):
    reasons, verdicts = interactions.evaluated({name: df.limit(0) for name, df in tables.items()})
    assert reasons.count() == verdicts.count() == 0


def test_interpretation(spark):
    df = spark.createDataFrame
    relationships = df([("a", "verified", "positive"), ("b", "verified", None), ("c", None, "negative"), ("d", "verified", "negative")], "relationship string, state string, assertion string")
    information = df([("a", "exposes"), ("d", "exposes"), ("d", "consumes")], "relationship string, direction string")
    participants = df([("a", "hub"), ("a", "hub")], "relationship string, ref string")
    needed = df([("a", 1, "hub"), ("a", 3, "x"), ("a", 2, "z")], "relationship string, place int, ref string")
    got = {r.relationship: (r.status, r.reason, r.unresolved) for r in interactions.interpreted(relationships, information, participants, needed).collect()}
    lost = "required_intermediate_not_in_participants:"
    assert got == {
        "a": ("positive", "positive_assertion", ["consumption_not_established", f"{lost}z", f"{lost}x"]),
        "b": ("unknown", "relationship_assertion_missing", ["relationship_assertion_missing", "assertion_content_unavailable"]),
        "c": ("unknown", "relationship_unresolved", ["assertion_content_unavailable"]),
        "d": ("explicit_negative", "explicit_negative_assertion", []),
    }


def test_lines_are_grouped_once(spark, sf_dir):
    """The groups of all lines were made anew in every branch of the plan."""
    import __spark_entry__

    found = __spark_entry__.queries()["interaction_reasons"](spark, sf_dir)
    assert not any("lineitem" in f for f in found.inputFiles())
