"""Architecture candidates against full enumeration and small expectations."""

import itertools

import pytest
from pyspark.sql import functions as F

from plumbline.operators import architectures as arch

LOAD = "project long, load string, kind string, voltage double, frequency double, power_w double, isolated boolean"
SOURCE = "project long, source string, source_kind string, kind string, voltage double"


def _project(spark, loads, sources, fixed=None):
    return (
        spark.createDataFrame([(1, fixed)], "project long, fixed_voltage double"),
        spark.createDataFrame([(1, *x) for x in loads], LOAD),
        spark.createDataFrame([(1, *x) for x in sources], SOURCE),
    )


def test_levels_are_full_enumeration_and_bounded(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(9)] + [(10, None)], "k long, x long")
    levels = [
        ("a", F.sequence(F.lit(0).cast("long"), F.col("x")), None),
        ("b", F.array(*[F.lit(v) for v in (1, 2, 2, 3)]), F.col("a") < 2),
        ("c", F.when(F.col("b") > 1, F.array(F.col("a"), F.col("b"))), None),
    ]
    got = sorted(tuple(r) for r in arch.expanded(rows, "k", levels, 12).collect())
    every = [
        (k, k % 3, a, b, c) for k, a, b in itertools.product(range(9), range(3), (1, 2, 3)) if a <= k % 3 and a < 2 and b > 1 for c in sorted({a, b})
    ]
    assert got == sorted(every)
    with pytest.raises(ValueError, match="c: more than 7"):
        arch.expanded(rows, "k", levels, 7)
    with pytest.raises(ValueError, match="a: more than 2"):
        arch.expanded(rows, "k", levels, 2)


def test_routes_and_status_of_one_project(spark):
    loads = [("light", "dc", 12.0, None, 10.0, None), ("fan", "dc", 12.0, None, 20.0, False), ("tv", "ac", 120.0, 60.0, 90.0, None)]
    projects, lo, so = _project(spark, loads, [("grid", "shore", "ac", 120.0)])
    candidates = arch.architecture_candidates(projects, lo, so)
    assert candidates.count() == 6
    roles = arch.candidate_roles(candidates, lo, so)
    status = {(r.house_voltage, r.arrangement): (r.status, r.unresolved) for r in arch.candidate_status(roles).collect()}
    # at 12 V both small loads are supplied directly; else they share a converter and nobody says which run at once
    assert status == {(v, a): ("eligible", 0) if v == 12 else ("unresolved", 1) for v in (12, 24, 48) for a in ("separate", "combined")}
    edges = arch.candidate_edges(candidates, lo, so).where("house_voltage = 24 and arrangement = 'combined'").orderBy("route", "step").collect()
    routes = {k: [f"{e.from_node}>{e.to_node}" for e in es] for k, es in itertools.groupby(edges, lambda e: e.route)}
    ac, dc = "conversion.ac:120.0:60.0", "conversion.dc:12.0:unknown"
    assert routes == {
        "charge.grid": [f"domain.source.grid>{ac}.input", f"{ac}.input>{ac}.dc", f"{ac}.dc>house"],
        "storage.charge": ["house>storage.port"],
        "storage.discharge": ["storage.port>house"],
        "supply.fan": [f"house>{dc}.dc", f"{dc}.dc>{dc}.output", f"{dc}.output>domain.dc:12.0:unknown", "domain.dc:12.0:unknown>demand.fan"],
        "supply.light": [f"house>{dc}.dc", f"{dc}.dc>{dc}.output", f"{dc}.output>domain.dc:12.0:unknown", "domain.dc:12.0:unknown>demand.light"],
        "supply.tv": [f"house>{ac}.dc", f"{ac}.dc>{ac}.output", f"{ac}.output>domain.ac:120.0:60.0", "domain.ac:120.0:60.0>demand.tv"],
    }
    capacity = roles.where("role = 'conversion.dc:12.0:unknown'").select("least_w", "reason").distinct().collect()
    assert [tuple(r) for r in capacity] == [(20.0, "concurrency_not_asserted")]


def test_what_blocks_and_what_stays_open(spark):
    loads = [("a", None, None, None, None, None), ("b", "dc", None, None, 5.0, None), ("c", "dc", 12.0, None, 5.0, True), ("d", "ac", 120.0, None, 5.0, None)]
    sources = [("s", "solar", "dc", None), ("v", "vehicle", "dc", None), ("w", "wind", "ac", 12.0)]
    projects, lo, so = _project(spark, loads, sources, 36.0)
    candidates = arch.architecture_candidates(projects, lo, so)
    assert [tuple(r) for r in candidates.collect()] == [(1, 36.0, "separate", False)]
    reason = {r.role: (r.function, r.reason) for r in arch.candidate_roles(candidates, lo, so, arch.Policy(convert_loads=False)).collect()}
    assert reason == {
        "house": (None, "voltage_not_in_policy"), "storage": ("storage", None),
        "conversion.unknown:unknown:unknown#a": ("dc_conversion", "conversion_not_allowed"), "direct.dc:unknown:unknown#b": (None, "domain_voltage_unknown"),
        "conversion.dc:12.0:unknown#c": ("dc_conversion", "conversion_not_allowed"), "conversion.ac:120.0:unknown#d": ("inverter", None),
        "charging.s": ("charging", "source_kind_conflict"), "charging.v": ("charging", "source_voltage_unknown"), "charging.w": ("charging", "source_kind_conflict"),
    }


def test_bounds_reject_and_empty_projects_have_storage_only(spark):
    projects, lo, so = _project(spark, [(f"l{i}", "dc", 12.0, None, 1.0, False) for i in range(65)], [])
    with pytest.raises(ValueError, match="64 loads"):
        arch.architecture_candidates(projects, lo, so)
    with pytest.raises(ValueError, match="house_voltage"):
        arch.architecture_candidates(projects, lo.limit(0), so, arch.Policy(voltages=range(1, 40)))
    candidates = arch.architecture_candidates(projects, lo.limit(0), so)
    assert candidates.count() == 3 and arch.candidate_edges(candidates, lo.limit(0), so).count() == 6
    assert {r.status for r in arch.candidate_status(arch.candidate_roles(candidates, lo.limit(0), so)).collect()} == {"eligible"}


def test_lines_are_numbered_once(spark, sf_dir):
    """The window over all lines was in every branch of the plan."""
    import __spark_entry__

    found = __spark_entry__.queries()["architecture_edges"](spark, sf_dir)
    assert not any("lineitem" in f for f in found.inputFiles())
