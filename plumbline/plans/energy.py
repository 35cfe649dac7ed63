"""Loads, sources, storage and wiring, bound to orders, line items, parts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import electrical as el
from ..functions.lattices import SEVERITY, worst
from ..operators import aggregates as ag
from ..operators import battery, sequences
from ..operators import power as pw
from ._registry import Tables, bind

EVENT_KEY = ["user_id", "day"]
EVENT_ORDER = ["ts", "event_id"]


def event_power(events: DataFrame) -> DataFrame:
    """Views, clicks and sign-ups charge, purchases discharge, errors are unknown; one hour each."""
    kind = F.col("event_type")
    net = F.when(kind.isin("view", "click", "signup"), F.col("value")).when(kind == "purchase", -F.col("value"))
    return events.select(
        "event_id", "user_id", "ts", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), net.alias("net_w")
    )


_EVENTS_SQL = """
e AS (SELECT event_id, user_id, ts, event_type, value, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN value WHEN event_type = 'purchase' THEN -value END AS net_w
  FROM events)
"""
_TRAJECTORY_SQL = f"""
WITH {_EVENTS_SQL}, t AS (
  SELECT *, net_w IS NOT NULL AS ok,
    min(CASE WHEN net_w IS NULL THEN 0 ELSE 1 END) OVER w AS pre, sum(net_w) OVER w AS run
  FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
)
"""


def _trajectory(t: Tables) -> DataFrame:
    return sequences.ordered_trajectory(
        event_power(t.events), EVENT_KEY, EVENT_ORDER, "net_w", F.lit(1.0), F.lit(False)
    )


@bind(
    _TRAJECTORY_SQL
    + """SELECT event_id, user_id, CASE WHEN ok THEN 'resolved' ELSE 'unresolved' END AS energy_status,
  round(net_w, 4) AS net_energy_wh, CASE WHEN pre = 1 THEN round(run, 4) END AS cumulative_energy_wh FROM t"""
)
def ordered_trajectory(t: Tables) -> DataFrame:
    return _trajectory(t).select(
        "event_id",
        "user_id",
        "energy_status",
        F.round("net_energy_wh", 4).alias("net_energy_wh"),
        F.round("cumulative_energy_wh", 4).alias("cumulative_energy_wh"),
    )


@bind(
    _TRAJECTORY_SQL
    + """SELECT user_id, day, count(*) AS intervals, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'CONDITIONAL' END AS severity,
  CASE WHEN bool_and(ok) THEN round(sum(net_w), 4) END AS ending_wh,
  CASE WHEN bool_and(ok) THEN round(greatest(0.0::DOUBLE, -least(0.0::DOUBLE, min(run))), 4) END AS max_deficit_wh,
  CASE WHEN bool_and(ok) THEN round(greatest(0.0::DOUBLE, max(run)), 4) END AS max_surplus_wh
FROM t GROUP BY user_id, day"""
)
def trajectory_summary(t: Tables) -> DataFrame:
    s = sequences.trajectory_summary(_trajectory(t), EVENT_KEY)
    return s.select(
        *EVENT_KEY, "intervals", "severity", *[F.round(c, 4).alias(c) for c in ("ending_wh", "max_deficit_wh", "max_surplus_wh")]
    )


_START, _LOW, _HIGH = 200.0, 50.0, 400.0
_STORED_SQL = f"""
WITH {_EVENTS_SQL}, k AS (SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM e), b AS (SELECT user_id, week, min((ts, event_id)) FILTER (net_w IS NULL) AS gap, count(*) FILTER (net_w IS NULL) AS unresolved FROM k GROUP BY user_id, week
), l AS (
  SELECT k.user_id, k.week, list({{'e': net_w, 'x': 0.0::DOUBLE, 'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'u': 0.0::DOUBLE}}
    ORDER BY ts, event_id) AS items FROM k JOIN b ON b.user_id = k.user_id AND b.week = k.week WHERE gap IS NULL OR (ts, event_id) < gap GROUP BY k.user_id, k.week
), r AS (
  SELECT user_id, week, list_reduce(list_prepend({{'e': 0.0::DOUBLE, 'x': {_START}::DOUBLE, 'lo': {_START}::DOUBLE,
    'hi': {_START}::DOUBLE, 'c': 0.0::DOUBLE, 'u': 0.0::DOUBLE}}, items), lambda s, i: {{
      'e': 0.0::DOUBLE,
      'x': least({_HIGH}::DOUBLE, greatest({_LOW}::DOUBLE, s.x + i.e)),
      'lo': least(s.lo, least({_HIGH}::DOUBLE, greatest({_LOW}::DOUBLE, s.x + i.e))),
      'hi': greatest(s.hi, least({_HIGH}::DOUBLE, greatest({_LOW}::DOUBLE, s.x + i.e))),
      'c': s.c + greatest(0.0::DOUBLE, s.x + i.e - {_HIGH}::DOUBLE),
      'u': s.u + greatest(0.0::DOUBLE, {_LOW}::DOUBLE - s.x - i.e)}}) AS z FROM l
)
SELECT b.user_id, b.week, CASE WHEN unresolved = 0 THEN round(z.x, 3) END AS stored_wh, CASE WHEN unresolved = 0 THEN round(z.lo, 3) END AS least_wh,
  CASE WHEN unresolved = 0 THEN round(z.hi, 3) END AS most_wh, round(coalesce(z.c, 0), 3) AS curtailed_wh, round(coalesce(z.u, 0), 3) AS unmet_wh, unresolved,
  CASE WHEN z.u > 1e-9 THEN 'FAIL' WHEN unresolved > 0 THEN 'CONDITIONAL' ELSE 'PASS' END AS severity FROM b LEFT JOIN r ON r.user_id = b.user_id AND r.week = b.week
"""


def _stored(t: Tables) -> DataFrame:
    """A trajectory for each user and week; errors are intervals of unknown power, which end what is known."""
    events = event_power(t.events).withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    return sequences.stored_energy(events, ["user_id", "week"], "day", EVENT_ORDER, "net_w", _START, _LOW, _HIGH)


@bind(_STORED_SQL)
def stored_energy_clamped(t: Tables) -> DataFrame:
    s = _stored(t)
    return s.select(
        "user_id", "week", *[F.round(c, 3).alias(c) for c in ("stored_wh", "least_wh", "most_wh", "curtailed_wh", "unmet_wh")], "unresolved", "severity"
    )


@bind(
    f"""WITH s AS ({_STORED_SQL})
SELECT user_id, week, round((stored_wh - {_LOW}::DOUBLE) / ({_HIGH - _LOW}::DOUBLE) * 100, 2) AS soc_percent,
  CASE WHEN abs((stored_wh - {_LOW}::DOUBLE) / ({_HIGH - _LOW}::DOUBLE) * 100 - 40) <= 1e-9 THEN 'at-reserve'
    WHEN (stored_wh - {_LOW}::DOUBLE) / ({_HIGH - _LOW}::DOUBLE) * 100 > 40 THEN 'above-reserve'
    WHEN stored_wh IS NOT NULL THEN 'below-reserve' END AS reserve_state,
  CASE WHEN stored_wh IS NULL THEN 'FAIL' ELSE 'PASS' END AS severity FROM s"""
)
def soc_observation(t: Tables) -> DataFrame:
    """An amount that is not known is no finite number, which an observation needs."""
    s = _stored(t).withColumn("stored_wh", F.round("stored_wh", 3))
    return battery.soc_observation(s, F.col("stored_wh"), F.lit(_LOW), F.lit(_HIGH), F.lit(40.0)).select(
        "user_id", "week", F.round("soc_percent", 2).alias("soc_percent"), "reserve_state", "severity"
    )


_LOADS_SQL = """
l AS (SELECT l_orderkey, l_linenumber, l_quantity AS power_w, 1 - l_tax AS eta, l_returnflag = 'R' AS ac,
    CASE WHEN l_linestatus = 'F' THEN false END AS active, 1 - l_discount AS duty, l_returnflag = 'N' AND l_discount > 0.09 AS unknown
  FROM lineitem),
c AS (SELECT *, CASE WHEN unknown THEN NULL WHEN ac THEN power_w / eta ELSE power_w END AS battery_w FROM l WHERE coalesce(active, true))
"""


def order_loads(t: Tables) -> DataFrame:
    """Line items as the loads of an order: returned ones are AC, some have an unknown power, finished ones are off."""
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(flag == "R", F.lit("ac")).otherwise(F.lit("dc")).alias("supply"),
        F.when(~((flag == "N") & (F.col("l_discount") > 0.09)), F.col("l_quantity")).alias("power_w"),
        (1 - F.col("l_tax")).alias("inverter_efficiency"),
        F.when(F.col("l_linestatus") == "F", F.lit(False)).alias("active"),
        (1 - F.col("l_discount")).alias("duty_cycle"),
        F.lit(2.0).alias("runtime_hours"),
    )


@bind(
    f"""WITH {_LOADS_SQL}
SELECT l_orderkey, count(*) AS loads, round(sum(CASE WHEN unknown THEN 0 ELSE power_w END), 3) AS load_side_w,
  CASE WHEN count(*) = count(battery_w) THEN round(sum(battery_w), 3) END AS battery_side_w,
  round(coalesce(sum(battery_w * 2 * duty), 0), 3) AS known_energy_wh, count(*) - count(battery_w) AS unresolved,
  CASE WHEN count(*) = count(battery_w) THEN 'PASS' ELSE 'CONDITIONAL' END AS severity FROM c GROUP BY l_orderkey"""
)
def load_demand(t: Tables) -> DataFrame:
    return pw.load_demand(order_loads(t), ["l_orderkey"]).select(
        "l_orderkey",
        "loads",
        *[F.round(c, 3).alias(c) for c in ("load_side_w", "battery_side_w", "known_energy_wh")],
        "unresolved",
        "severity",
    )


@bind(
    """SELECT l_orderkey, CASE WHEN bool_and(l_discount < 0.1 AND l_quantity > 0) THEN round(sum(l_extendedprice * l_quantity), 2) END AS power_w,
  CASE WHEN bool_and(l_discount < 0.1 AND l_quantity > 0) THEN 'ok' ELSE 'invalid_input' END AS code FROM lineitem GROUP BY l_orderkey"""
)
def load_power_guarded(t: Tables) -> DataFrame:
    valid = (F.col("l_discount") < 0.1) & (F.col("l_quantity") > 0)
    out = t.lineitem.groupBy("l_orderkey").agg(
        F.round(ag.guarded_sum(F.col("l_extendedprice") * F.col("l_quantity"), valid), 2).alias("power_w")
    )
    return out.withColumn("code", F.when(F.col("power_w").isNull(), F.lit("invalid_input")).otherwise(F.lit("ok")))


@bind(
    f"""WITH {_EVENTS_SQL}, h AS (SELECT user_id, day, 0.5::DOUBLE AS hours, net_w FROM e)
SELECT user_id, day, sum(hours) AS modeled_hours, round(coalesce(sum(net_w * hours), 0), 4) AS known_wh,
  CASE WHEN count(*) = count(net_w) AND sum(hours) = 1.0 THEN round(sum(net_w * hours), 4) END AS total_wh,
  CASE WHEN sum(hours) > 1.0 THEN 'FAIL' WHEN count(*) > count(net_w) OR sum(hours) < 1.0 THEN 'CONDITIONAL' ELSE 'PASS' END AS severity
FROM h GROUP BY user_id, day"""
)
def usage_profile_coverage(t: Tables) -> DataFrame:
    uses = event_power(t.events).withColumn("hours", F.lit(0.5))
    out = pw.usage_profile(uses, EVENT_KEY, "net_w", "hours", 1.0)
    return out.select(*EVENT_KEY, "modeled_hours", F.round("known_wh", 4).alias("known_wh"), F.round("total_wh", 4).alias("total_wh"), "severity")


@bind(
    """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS need, count(*)::DOUBLE AS hours FROM orders GROUP BY 1)
SELECT c_custkey, round(need, 2) AS required_wh, hours, round(need / hours, 8) AS average_w,
  CASE WHEN c_acctbal >= 0 THEN round(c_acctbal * 20 * hours, 2) END AS recoverable_wh,
  CASE WHEN c_acctbal < 0 THEN 'CONDITIONAL' WHEN c_acctbal * 20 * hours >= need - 1e-9 THEN 'PASS' ELSE 'FAIL' END AS severity
FROM customer JOIN o ON o_custkey = c_custkey"""
)
def recharge_window(t: Tables) -> DataFrame:
    need = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("need"), F.count("*").cast("double").alias("hours")
    )
    accepted = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * 20)
    out = battery.recharge_window(t.customer.join(need, "c_custkey"), F.col("need"), F.col("hours"), accepted)
    return out.select(
        "c_custkey", F.round("need", 2).alias("required_wh"), "hours", F.round("average_w", 8).alias("average_w"),
        F.round("recoverable_wh", 2).alias("recoverable_wh"), "severity",
    )


@bind(
    """SELECT p_partkey, CASE WHEN p_size <= 45 THEN round(p_retailprice * p_size, 4) END AS adjusted_wh,
  CASE WHEN p_size <= 45 THEN round(p_retailprice * p_size / ((50 - p_size)::DOUBLE / 50), 4) END AS nominal_wh,
  CASE WHEN p_size <= 45 THEN 'PASS' ELSE 'FAIL' END AS severity FROM part"""
)
def storage_requirement(t: Tables) -> DataFrame:
    usable = F.when(F.col("p_size") <= 45, (50 - F.col("p_size")).cast("double") / 50)
    out = battery.storage_requirement(t.part, F.col("p_retailprice"), F.col("p_size").cast("double"), usable)
    return out.select(
        "p_partkey", F.round("adjusted_wh", 4).alias("adjusted_wh"), F.round("nominal_wh", 4).alias("nominal_wh"), "severity"
    )


@bind(
    """WITH s AS (SELECT date_trunc('month', l_shipdate) AS m, CASE WHEN l_tax < 0.075 THEN l_quantity * (1 - l_discount) END AS wh FROM lineitem)
SELECT strftime(m, '%Y-%m') AS interval_id, row_number() OVER (ORDER BY m) - 1 AS sequence_index, round(coalesce(sum(wh), 0), 3) AS known_wh,
  CASE WHEN count(*) = count(wh) THEN round(sum(wh), 3) END AS total_wh,
  CASE WHEN count(*) = count(wh) THEN 'resolved' ELSE 'unresolved' END AS energy_status FROM s GROUP BY m"""
)
def variable_source_sequence(t: Tables) -> DataFrame:
    wh = F.when(F.col("l_tax") < 0.075, F.col("l_quantity") * (1 - F.col("l_discount")))
    parts = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("interval_id"), wh.alias("wh"))
    out = pw.source_sequence(parts, "interval_id", "wh")
    return out.select(
        "interval_id", F.col("sequence_index").cast("long"), F.round("known_wh", 3).alias("known_wh"), F.round("total_wh", 3).alias("total_wh"), "energy_status"
    )


@bind(
    f"""WITH {_LOADS_SQL}, d AS (SELECT l_orderkey, CASE WHEN count(*) = count(battery_w) THEN sum(battery_w) END AS demand FROM c GROUP BY 1),
b AS (SELECT o_orderkey, o_totalprice / 1000 AS accepted, demand, o_totalprice / 1000 - demand AS net FROM orders LEFT JOIN d ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(net, 3) AS net_w, round(CASE WHEN net >= 0 THEN net WHEN net < 0 THEN 0 END, 3) AS surplus_w, round(CASE WHEN net <= 0 THEN -net WHEN net > 0 THEN 0 END, 3) AS deficit_w,
  CASE WHEN net > 0 THEN 'charging' WHEN net < 0 THEN 'discharging' WHEN net = 0 THEN 'balanced' END AS balance_state,
  CASE WHEN net IS NULL THEN 'CONDITIONAL' ELSE 'PASS' END AS severity FROM b"""
)
def power_balance(t: Tables) -> DataFrame:
    return _balance(t).select(
        "o_orderkey", *[F.round(c, 3).alias(c) for c in ("net_w", "surplus_w", "deficit_w")], "balance_state", "severity"
    )


def _balance(t: Tables) -> DataFrame:
    demand = pw.load_demand(order_loads(t), ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"), "battery_side_w")
    cases = t.orders.join(demand, "o_orderkey", "left").withColumn("accepted_w", F.col("o_totalprice") / 1000)
    return pw.power_balance(cases, F.col("battery_side_w"), F.col("accepted_w"))


@bind(
    """WITH o AS (SELECT c_nationkey, o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice / 20000) END AS v
  FROM orders JOIN customer ON c_custkey = o_custkey), m AS (SELECT c_nationkey, max(v) AS top FROM o GROUP BY 1)
SELECT o.c_nationkey, max(top)::DOUBLE AS value_w, count(*) FILTER (v = top) AS governors, min(o_orderkey) FILTER (v = top) AS first_governor,
  count(*) FILTER (v IS NULL) AS unresolved, CASE WHEN count(*) FILTER (v IS NULL) > 0 THEN 'unresolved' ELSE 'resolved' END AS status
FROM o JOIN m USING (c_nationkey) GROUP BY o.c_nationkey"""
)
def power_envelope_ties(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 20000).cast("double"))
    cases = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", value.alias("v"))
    out = ag.governors(cases, ["c_nationkey"], "o_orderkey", "v")
    return out.select(
        "c_nationkey", F.col("max_value").alias("value_w"), "governors", "first_governor", "unresolved", "status"
    )


@bind(
    """WITH s AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS p, max(o_totalprice) AS pk, count(DISTINCT o_orderstatus) AS k
  FROM orders GROUP BY 1, 2), m AS (SELECT o_orderpriority, max(p) AS tp, max(pk) AS tk FROM s GROUP BY 1)
SELECT s.o_orderpriority, round(max(tp), 2) AS max_power, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) FILTER (p = tp) AS power_governors,
  round(max(tk), 2) AS max_peak, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) FILTER (pk = tk) AS peak_governors, count(*) > 1 AS voltage_conflict
FROM s JOIN m USING (o_orderpriority) GROUP BY 1"""
)
def scenario_envelope(t: Tables) -> DataFrame:
    # sums of doubles differ with their order, and these are compared with their own maximum: exact ones do not
    exact = F.sum(F.col("o_totalprice").cast("decimal(28,10)")).cast("double")
    scenarios = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(exact.alias("p"), F.max("o_totalprice").alias("pk"))
    return pw.scenario_envelope(scenarios, "o_orderpriority", "o_orderstatus", "p", "pk").select(
        "o_orderpriority", F.round("max_power", 2).alias("max_power"), "power_governors",
        F.round("max_peak", 2).alias("max_peak"), "peak_governors", "voltage_conflict",
    )


@bind(
    """WITH s AS (SELECT o_orderpriority, o_custkey, CASE WHEN bool_and(o_orderstatus <> 'P') THEN max(floor(o_totalprice / 5000)) END AS peak FROM orders GROUP BY 1, 2),
m AS (SELECT o_orderpriority, max(peak) AS top FROM s GROUP BY 1)
SELECT o_orderpriority, o_custkey, peak::DOUBLE AS peak, CASE WHEN peak IS NULL THEN 'unresolved' ELSE 'governing' END AS role FROM s JOIN m USING (o_orderpriority) WHERE peak IS NULL OR peak = top"""
)
def scenario_governors(t: Tables) -> DataFrame:
    """The scenarios that reach the peak of their priority, ties as rows, and those whose peak is unknown."""
    peak = F.when(F.bool_and(F.col("o_orderstatus") != "P"), F.max(F.floor(F.col("o_totalprice") / 5000))).cast("double")
    scenarios = t.orders.groupBy("o_orderpriority", "o_custkey").agg(peak.alias("peak"))
    return ag.governor_rows(scenarios, ["o_orderpriority"], "peak")


@bind(
    """SELECT p_partkey, p_brand, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand
  AND b.p_retailprice >= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size > a.p_size))"""
)
def surge_skyline(t: Tables) -> DataFrame:
    return ag.skyline(t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size"), ["p_brand"], "p_retailprice", "p_size").select(
        "p_partkey", "p_brand", "p_retailprice", "p_size"
    )


_SOURCES_SQL = """
s AS (SELECT s_suppkey, s_nationkey, abs(s_acctbal) AS installed, CASE WHEN s_suppkey % 5 = 0 THEN abs(s_acctbal) * 0.5 END AS cfg,
  s_suppkey % 3 <> 0 AS active, CASE s_suppkey % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unavailable' ELSE 'available' END AS availability,
  CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey END AS grp FROM supplier),
g AS (SELECT *, grp IS NOT NULL AND active AND count(*) FILTER (active) OVER (PARTITION BY grp) > 1 AS clash, coalesce(cfg, installed) AS configured FROM s)
"""


def nation_sources(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    installed = F.abs("s_acctbal")
    return t.supplier.select(
        "s_suppkey",
        "s_nationkey",
        installed.alias("installed_w"),
        F.when(k % 5 == 0, installed * 0.5).alias("limit_w"),
        (k % 3 != 0).alias("active"),
        F.when(k % 4 == 0, F.lit("unresolved")).when(k % 4 == 1, F.lit("unavailable")).otherwise(F.lit("available")).alias("availability"),
        F.when(k % 7 == 0, F.col("s_nationkey")).alias("exclusive_group"),
    )


@bind(
    f"""WITH {_SOURCES_SQL}
SELECT s_nationkey, round(sum(installed), 2) AS installed_w,
  round(coalesce(sum(configured) FILTER (active AND NOT clash AND availability <> 'unavailable'), 0), 2) AS configured_w,
  round(coalesce(sum(configured) FILTER (active AND NOT clash AND availability = 'available'), 0), 2) AS available_w,
  CASE WHEN bool_or(clash) THEN 'FAIL' WHEN bool_or(active AND NOT clash AND availability = 'unresolved') THEN 'CONDITIONAL' ELSE 'PASS' END AS severity
FROM g GROUP BY s_nationkey"""
)
def charging_capability(t: Tables) -> DataFrame:
    return pw.charging_capability(nation_sources(t), ["s_nationkey"]).select(
        "s_nationkey", *[F.round(c, 2).alias(c) for c in ("installed_w", "configured_w", "available_w")], "severity"
    )


@bind(
    f"""WITH {_SOURCES_SQL}, a AS (SELECT * FROM g WHERE active)
SELECT s_nationkey, CASE WHEN bool_or(clash) THEN 'FAIL' WHEN bool_or(availability = 'unavailable') THEN 'CONDITIONAL'
    WHEN bool_or(availability = 'unresolved') THEN 'CONDITIONAL' ELSE 'PASS' END AS severity,
  CASE WHEN bool_or(clash) THEN 'source.concurrent_combination_invalid' WHEN bool_or(availability = 'unavailable') THEN 'source.not_available_in_scenario'
    WHEN bool_or(availability = 'unresolved') THEN 'source.available_capability_missing' ELSE 'source.pass' END AS code,
  CASE WHEN bool_or(clash) OR bool_or(availability <> 'available') THEN 0.0::DOUBLE ELSE round(sum(least(installed, coalesce(cfg, installed))), 2) END AS available_w
FROM a GROUP BY s_nationkey"""
)
def source_concurrency(t: Tables) -> DataFrame:
    return pw.source_concurrency(nation_sources(t), ["s_nationkey"]).select(
        "s_nationkey", "severity", "code", F.round("available_w", 2).alias("available_w")
    )


@bind(
    f"""WITH {_SOURCES_SQL}, a AS (SELECT s_nationkey, coalesce(sum(configured) FILTER (active AND NOT clash AND availability = 'available'), 0) / 48 AS amps,
    bool_or(clash) AS failed FROM g GROUP BY 1),
k AS (SELECT c_custkey, amps, failed, CASE WHEN c_acctbal > 0 THEN c_acctbal / 50 END AS rec, CASE WHEN c_custkey % 4 <> 0 THEN abs(c_acctbal) / 25 END AS mx,
  CASE WHEN c_custkey % 6 = 0 THEN abs(c_acctbal) / 20 END AS prot FROM customer JOIN a ON s_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN failed OR amps > prot OR amps > mx THEN 'FAIL' WHEN (rec IS NULL AND mx IS NULL) OR (amps > rec AND mx IS NULL) THEN 'CONDITIONAL'
    WHEN amps > rec THEN 'WARNING' ELSE 'PASS' END AS severity,
  round(CASE WHEN mx IS NULL THEN CASE WHEN amps <= rec THEN amps END ELSE least(amps, mx) END, 3) AS usable_a FROM k"""
)
def charge_acceptance(t: Tables) -> DataFrame:
    amps = pw.charging_capability(nation_sources(t), ["s_nationkey"]).select(
        F.col("s_nationkey").alias("c_nationkey"), (F.col("available_w") / 48).alias("amps"), (F.col("severity") == "FAIL").alias("failed")
    )
    bank = t.customer.select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 50).alias("recommended_a"),
        F.when(F.col("c_custkey") % 4 != 0, F.abs("c_acctbal") / 25).alias("maximum_a"),
        F.when(F.col("c_custkey") % 6 == 0, F.abs("c_acctbal") / 20).alias("protection_a"),
    )
    out = battery.charge_acceptance(bank.join(amps, "c_nationkey"), F.col("amps"), F.col("failed"))
    return out.select("c_custkey", "severity", F.round("usable_a", 3).alias("usable_a"))


@bind(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'CONDITIONAL' WHEN c_acctbal > 9000 THEN 'FAIL' WHEN c_acctbal > 7500 THEN 'FAIL'
    WHEN c_acctbal > 5000 THEN 'WARNING' ELSE 'PASS' END AS severity,
  CASE WHEN c_acctbal < 0 THEN 'semantics_unknown' WHEN c_acctbal > 9000 THEN 'protection_limit_exceeded' WHEN c_acctbal > 7500 THEN 'configuration_limit_exceeded'
    WHEN c_acctbal > 5000 THEN 'recommended_rate_exceeded' ELSE 'within_limits' END AS code FROM customer"""
)
def charge_rate_ladder(t: Tables) -> DataFrame:
    out = battery.charge_rate(t.customer, F.col("c_acctbal"), F.lit(5000.0), F.lit(7500.0), F.lit(9000.0))
    return out.select("c_custkey", "severity", "code")


@bind(
    """SELECT p_partkey, s.s::INTEGER AS series, p.p::INTEGER AS parallel, (s.s * p.p)::INTEGER AS units, s.s * 12.0::DOUBLE AS bank_v, p.p * p_size::DOUBLE AS bank_ah
FROM part, range(1, 5) s(s), range(1, 4) p(p) WHERE s.s <= 1 + p_size % 4 AND p.p <= 1 + p_size % 3"""
)
def bank_enumeration(t: Tables) -> DataFrame:
    parts = t.part.select(
        "p_partkey", F.lit(12.0).alias("unit_v"), F.col("p_size").cast("double").alias("unit_ah"),
        (1 + F.col("p_size") % 4).alias("max_series"), (1 + F.col("p_size") % 3).alias("max_parallel"),
    )
    return battery.enumerate_banks(parts).select("p_partkey", "series", "parallel", "units", "bank_v", "bank_ah")


@bind(
    """SELECT o_orderkey, v::DOUBLE AS voltage_v, round(o_totalprice / 0.9::DOUBLE / v, 8) AS current_a FROM orders, (VALUES (12), (24), (48)) c(v)"""
)
def voltage_candidates(t: Tables) -> DataFrame:
    out = pw.voltage_candidates(t.orders, F.col("o_totalprice"), F.lit(0.9), (12.0, 24.0, 48.0))
    return out.select("o_orderkey", "voltage_v", F.round("current_a", 8).alias("current_a"))


@bind(
    """WITH w AS (SELECT l_orderkey, l_linenumber, p_size::DOUBLE AS ampacity, l_quantity AS amps, 2 * l_quantity * (1 + l_partkey % 7) * (0.0005 + p_size * 0.00001) / 48 * 100 AS pct
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, ampacity >= amps AS ampacity_passes, pct <= 3 AS drop_passes, ampacity >= amps AND pct <= 3 AS eligible, round(pct, 6) AS drop_percent FROM w"""
)
def wire_candidates(t: Tables) -> DataFrame:
    runs = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("p_size").cast("double").alias("ampacity_a"), F.col("l_quantity").alias("current_a"),
        (1 + F.col("l_partkey") % 7).alias("one_way_m"), (0.0005 + F.col("p_size") * 0.00001).alias("ohm_per_m"),
    )
    out = pw.wire_candidates(runs, F.lit(48.0), F.lit(3.0))
    return out.select("l_orderkey", "l_linenumber", "ampacity_passes", "drop_passes", "eligible", F.round("drop_percent", 6).alias("drop_percent"))


@bind(
    """WITH f AS (SELECT l_partkey, list(1 - l_discount ORDER BY l_orderkey, l_linenumber) AS x FROM lineitem GROUP BY 1)
SELECT l_partkey, len(x) AS factors, round(list_reduce(list_prepend(1.0::DOUBLE, x), lambda a, b: a * b), 6) AS derating FROM f"""
)
def derating_product(t: Tables) -> DataFrame:
    out = pw.derating(t.lineitem.withColumn("factor", 1 - F.col("l_discount")), ["l_partkey"], "factor")
    return out.select("l_partkey", F.col("factors").cast("long").alias("factors"), F.round("derating", 6).alias("derating"))


@bind(
    """WITH v AS (SELECT p_partkey, (1 + p_size % 12) AS ns, p_retailprice / 40 AS vref FROM part), r AS (
  SELECT p_partkey, ns * vref * (1 + -0.003 * (-10.0 - 25)) * 1.02 AS cold, ns * vref * (1 + -0.003 * (70.0 - 25)) * 1.02 AS hot,
    ns * vref * 0.82 * (1 + -0.004 * (70.0 - 25)) * 0.98 AS vmp FROM v)
SELECT p_partkey, round(greatest(cold, hot), 8) AS cold_voc, round(vmp, 8) AS hot_vmp,
  CASE WHEN greatest(cold, hot) > 250 THEN 'BLOCKED' WHEN vmp < 60 THEN 'BLOCKED' ELSE 'ELIGIBLE' END AS status FROM r"""
)
def pv_string_voltage(t: Tables) -> DataFrame:
    ns, vref, u = (1 + F.col("p_size") % 12).cast("double"), F.col("p_retailprice") / 40, F.lit(0.02)
    voc = [el.temperature_voltage(ns, vref, F.lit(-0.003), F.lit(c), F.lit(25.0), u, True) for c in (-10.0, 70.0)]
    vmp = el.temperature_voltage(ns, vref * 0.82, F.lit(-0.004), F.lit(70.0), F.lit(25.0), u, False)
    out = t.part.select("p_partkey", F.greatest(*voc).alias("voc"), vmp.alias("vmp"))
    status = F.when(F.col("voc") > 250, F.lit("BLOCKED")).when(F.col("vmp") < 60, F.lit("BLOCKED"))
    status = status.when(F.col("voc").isNull() | F.col("vmp").isNull(), F.lit("UNRESOLVED")).otherwise(F.lit("ELIGIBLE"))
    return out.select("p_partkey", F.round("voc", 8).alias("cold_voc"), F.round("vmp", 8).alias("hot_vmp"), status.alias("status"))


@bind(
    """WITH d AS (SELECT l_suppkey, l_returnflag AS unit, sum(l_quantity) AS v, count(*) FILTER (l_tax > 0.079) AS odd FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_suppkey, count(*) FILTER (unit <> 'A') AS mixed, sum(v) FILTER (unit = 'A') AS demand, sum(v) AS every FROM d GROUP BY 1)
SELECT s_suppkey, coalesce(demand, 0) AS demand, CASE WHEN every IS NULL THEN 'UNRESOLVED' WHEN coalesce(demand, 0) <= abs(s_acctbal) THEN 'ELIGIBLE' ELSE 'BLOCKED' END AS status
FROM supplier LEFT JOIN g ON l_suppkey = s_suppkey"""
)
def shared_capacity(t: Tables) -> DataFrame:
    demands = t.lineitem.select(F.col("l_suppkey").alias("group_id"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("value"), F.lit("W").alias("unit"))
    groups = t.supplier.select(F.col("s_suppkey").alias("group_id"), F.abs("s_acctbal").alias("limit"), F.lit("W").alias("unit"))
    out = pw.shared_capacity(demands, groups)
    return out.select(F.col("group_id").alias("s_suppkey"), "demand", "status")


_ROUTE_SQL = f"""
WITH {_EVENTS_SQL}, r AS (SELECT user_id, day, ts, event_id, event_id % 9 AS src, (event_id + 1 + user_id % 2) % 9 AS dst FROM e),
w AS (SELECT *, coalesce(lag(dst) OVER k <> src, false) AS gap, dst = first_value(src) OVER k AS back FROM r WINDOW k AS (PARTITION BY user_id, day ORDER BY ts, event_id))
SELECT user_id, day, count(*) AS edges, count(*) FILTER (gap) AS gaps, count(*) - count(DISTINCT dst) + count(*) FILTER (back) AS revisits,
  CASE WHEN count(*) FILTER (gap) > 0 OR count(*) - count(DISTINCT dst) + count(*) FILTER (back) > 0 THEN 'blocked' ELSE 'satisfied' END AS status
FROM w GROUP BY user_id, day
"""


@bind(_ROUTE_SQL)
def route_walk(t: Tables) -> DataFrame:
    steps = event_power(t.events).select(
        *EVENT_KEY, *EVENT_ORDER, (F.col("event_id") % 9).alias("src"), ((F.col("event_id") + 1 + F.col("user_id") % 2) % 9).alias("dst")
    )
    return sequences.route_walk(steps, EVENT_KEY, EVENT_ORDER, "src", "dst")


@bind(
    """SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS routes FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1"""
)
def shared_edge_usage(t: Tables) -> DataFrame:
    return pw.shared_edges(t.lineitem, ["l_partkey", "l_suppkey"], "l_orderkey")


@bind(
    """WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 1 END AS r FROM orders)
SELECT c_custkey, CASE max(r) WHEN 3 THEN 'CONDITIONAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'PASS' ELSE 'CONDITIONAL' END AS severity, count(r) AS subsystems
FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def system_worst_status(t: Tables) -> DataFrame:
    """A system without a subsystem is CONDITIONAL."""
    s = F.col("o_orderstatus")
    status: Column = F.when(s == "O", F.lit("WARNING")).when(s == "P", F.lit("CONDITIONAL")).when(s.isNotNull(), F.lit("PASS"))
    parts = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", status.alias("severity"))
    return parts.groupBy("c_custkey").agg(
        worst(F.col("severity"), SEVERITY, "CONDITIONAL").alias("severity"), F.count("severity").alias("subsystems")
    )


@bind(
    f"""WITH RECURSIVE {_EVENTS_SQL}, r AS (SELECT user_id, day, event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS k, 100.0::DOUBLE + user_id % 50 AS demand,
  event_id % 23 <> 0 AS usable, event_id % 3 = 0 AS converts, CASE WHEN event_id % 19 <> 0 THEN (80 + event_id % 22) / 100.0::DOUBLE END AS eff, CASE WHEN event_id % 5 <> 0 THEN 100.0 + event_id % 200 END AS rating,
  CASE WHEN event_id % 2 = 0 THEN value * 4 END AS to_limit, CASE WHEN event_id % 4 = 1 THEN value * 5 END AS from_limit FROM e),
w AS (
  SELECT user_id, day, NULL::BIGINT AS event_id, 0::BIGINT AS k, NULL::DOUBLE AS to_w, demand AS from_w, NULL::VARCHAR AS status FROM r WHERE k = 1
  UNION ALL
  SELECT user_id, day, event_id, k, to_w, from_w, CASE WHEN coalesce(to_w > to_limit, false) OR coalesce(from_w > from_limit, false) OR (converts AND coalesce(to_w > rating, false)) THEN 'blocked'
    WHEN from_w IS NULL OR (converts AND rating IS NULL) THEN 'unresolved' ELSE 'satisfied' END
  FROM (SELECT *, CASE WHEN NOT converts THEN to_w WHEN eff > 0 AND eff <= 1 THEN to_w / eff END AS from_w
    FROM (SELECT r.*, CASE WHEN usable THEN w.from_w END AS to_w FROM w JOIN r ON r.user_id = w.user_id AND r.day = w.day AND r.k = w.k + 1))
)
SELECT event_id, round(to_w, 6) AS to_w, round(from_w, 6) AS from_w, status FROM w WHERE k > 0"""
)
def backward_demand(t: Tables) -> DataFrame:
    """Events of a user's day as the edges of a route."""
    k = F.col("event_id")
    edges = event_power(t.events).select(
        *EVENT_KEY, *EVENT_ORDER, (F.lit(100.0) + F.col("user_id") % 50).alias("demand"), (k % 23 != 0).alias("usable"), (k % 3 == 0).alias("converts"),
        F.when(k % 19 != 0, (80 + k % 22) / 100).alias("eff"), F.when(k % 5 != 0, 100.0 + k % 200).alias("rating"),
        F.when(k % 2 == 0, F.col("value") * 4).alias("to_limit"), F.when(k % 4 == 1, F.col("value") * 5).alias("from_limit"),
    )
    out = sequences.demand_backwards(edges, EVENT_KEY, EVENT_ORDER, "demand", "usable", "converts", "eff", "rating", "to_limit", "from_limit")
    return out.select("event_id", F.round("to_w", 6).alias("to_w"), F.round("from_w", 6).alias("from_w"), "status")
