"""Banks, charge limits, state of charge and recovery windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import electrical as el


def soc_observation(df: DataFrame, stored: Column, low: Column, high: Column, reserve_percent: Column) -> DataFrame:
    """``df`` with ``soc_percent`` of the usable window, ``reserve_state`` and ``severity``.  A window of no width is
    CONDITIONAL, an amount outside it FAIL; both leave the percentage unknown."""
    t = el.TOLERANCE
    bad = ~el.finite(stored) | ~el.non_negative(low) | ~el.finite(high) | (high < low - t)
    bad = bad | (stored < low - t) | (stored > high + t)
    flat = F.abs(high - low) <= t
    soc = F.when(~bad & ~flat, (stored - low) / (high - low) * 100)
    out = df.withColumn("soc_percent", soc).withColumn(
        "severity", F.when(bad, F.lit("FAIL")).when(flat, F.lit("CONDITIONAL")).otherwise(F.lit("PASS"))
    )
    margin = F.col("soc_percent") - reserve_percent
    return out.withColumn(
        "reserve_state",
        F.when(F.abs(margin) <= t, F.lit("at-reserve")).when(margin > 0, F.lit("above-reserve")).when(margin < 0, F.lit("below-reserve")),
    )


def recharge_window(df: DataFrame, need: Column, hours: Column, accepted: Column) -> DataFrame:
    """``df`` with the average power that recovery needs, what the accepted power recovers, and whether it is enough."""
    recoverable = accepted * hours
    bad = ~el.non_negative(need) | ~el.non_negative(hours) | (accepted.isNotNull() & ~el.non_negative(accepted))
    return df.withColumns(
        {
            "average_w": F.when(~bad & (hours > 0), need / hours),
            "recoverable_wh": F.when(~bad, recoverable),
            "severity": F.when(bad, F.lit("FAIL"))
            .when(need == 0, F.lit("PASS"))
            .when(hours == 0, F.lit("FAIL"))
            .when(accepted.isNull(), F.lit("CONDITIONAL"))
            .when(recoverable >= need - el.TOLERANCE, F.lit("PASS"))
            .otherwise(F.lit("FAIL")),
        }
    )


def storage_requirement(df: DataFrame, usable_wh: Column, periods: Column, fraction: Column) -> DataFrame:
    """``df`` with energy over all periods and the nominal energy that holds it; FAIL where an input is invalid."""
    ok = F.coalesce(el.non_negative(usable_wh) & el.positive(periods) & el.efficiency(fraction), F.lit(False))
    return df.withColumns(
        {
            "adjusted_wh": F.when(ok, el.normalized(usable_wh * periods)),
            "nominal_wh": F.when(ok, el.normalized(usable_wh * periods / fraction)),
            "severity": F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL")),
        }
    )


def charge_acceptance(df: DataFrame, source_a: Column, source_failed: Column) -> DataFrame:
    """``df`` (``recommended_a, maximum_a, protection_a``) with ``severity`` and ``usable_a``."""
    rec, most, prot = F.col("recommended_a"), F.col("maximum_a"), F.col("protection_a")
    over = lambda limit: F.coalesce(source_a > limit, F.lit(False))
    usable = F.when(most.isNull(), F.when(~over(rec) & rec.isNotNull(), source_a)).otherwise(F.least(source_a, most))
    return df.withColumns(
        {
            "severity": F.when(source_failed | over(prot) | over(most), F.lit("FAIL"))
            .when(source_a.isNull() | (rec.isNull() & most.isNull()) | (over(rec) & most.isNull()), F.lit("CONDITIONAL"))
            .when(over(rec), F.lit("WARNING"))
            .otherwise(F.lit("PASS")),
            "usable_a": F.when(source_a.isNotNull(), usable),
        }
    )


def charge_rate(df: DataFrame, current: Column, recommended: Column, maximum: Column, protection: Column) -> DataFrame:
    """The ladder protection, maximum, recommended; the first limit exceeded decides."""
    steps = (
        (~el.non_negative(current), "CONDITIONAL", "semantics_unknown"),
        (current > protection, "FAIL", "protection_limit_exceeded"),
        (current > maximum, "FAIL", "configuration_limit_exceeded"),
        (current > recommended, "WARNING", "recommended_rate_exceeded"),
    )
    severity, code = F.lit("PASS"), F.lit("within_limits")
    for when, s, c in reversed(steps):
        severity, code = F.when(when, F.lit(s)).otherwise(severity), F.when(when, F.lit(c)).otherwise(code)
    return df.withColumn("severity", severity).withColumn("code", code)


def charger_output(rated: Column, limit: Column, available: Column, eta: Column) -> Column:
    """Power that a charger can give: the least of its rating, its configured limit and its converted input."""
    given = ((limit, el.non_negative), (available, el.non_negative), (eta, el.efficiency))
    bad = ~el.non_negative(rated)
    for x, valid in given:
        bad = bad | (x.isNotNull() & ~valid(x))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(rated, limit, available * F.coalesce(eta, F.lit(1.0))))


def enumerate_banks(units: DataFrame) -> DataFrame:
    """All series and parallel counts that a unit allows (``max_series, max_parallel``), with the bank's ratings; a unit
    without limits has none."""
    grid = units.withColumn("series", F.explode(F.sequence(F.lit(1), F.col("max_series"))))
    grid = grid.withColumn("parallel", F.explode(F.sequence(F.lit(1), F.col("max_parallel"))))
    return grid.withColumns(
        {
            "units": F.col("series") * F.col("parallel"),
            "bank_v": F.col("series") * F.col("unit_v"),
            "bank_ah": F.col("parallel") * F.col("unit_ah"),
        }
    )


def bank_checks(banks: DataFrame) -> DataFrame:
    """Banks (``series, parallel, max_series, max_parallel, unit_v, unit_ah, unit_a, peak_a, peak_s``) against what is asked of
    them (``need_v, need_wh, need_a, surge_a, surge_s``): a code per check and ``severity``, the worst.

    A bank beyond its limits is not permitted, which leaves every check CONDITIONAL; unknown ratings do too.  A check that
    fails says whether a larger permitted bank would pass, whether none larger is permitted, or that even the largest is
    too small.  Voltage must be met exactly.  A surge that is not asked for (both columns null) passes.
    """
    c = F.col
    permitted = F.coalesce((c("series") >= 1) & (c("series") <= c("max_series")) & (c("parallel") >= 1) & (c("parallel") <= c("max_parallel")), F.lit(False))
    code = lambda *steps: F.coalesce(*[F.when(when, F.lit(name)) for when, name in steps])
    forbidden = (~permitted, "topology_not_permitted")
    volts = c("series") * c("unit_v")
    rises = F.round((c("need_v") / c("unit_v")), 0)
    other_series = (rises > c("series")) & (rises <= c("max_series")) & (rises * c("unit_v") == c("need_v"))
    amps = c("parallel") * c("unit_a")
    more_amps = c("max_parallel") * c("unit_a") >= c("need_a")
    wh = volts * c("parallel") * c("unit_ah")
    most_wh = c("max_series") * c("max_parallel") * c("unit_v") * c("unit_ah")
    peak = c("parallel") * c("peak_a")
    no_surge = c("surge_a").isNull() & c("surge_s").isNull()
    codes = {
        "voltage_code": code(
            (~F.coalesce(c("need_v") > 0, F.lit(False)), "voltage_requirement_invalid"), forbidden, (volts == c("need_v"), "voltage_requirement_pass"),
            (other_series, "voltage_requirement_insufficient"), (c("max_series") <= c("series"), "series_not_permitted"), (F.lit(True), "max_series_insufficient"),
        ),
        "energy_code": code(
            (~el.non_negative(c("need_wh")), "energy_requirement_invalid"), forbidden, (wh >= c("need_wh"), "energy_requirement_pass"),
            (most_wh >= c("need_wh"), "energy_requirement_insufficient"), (F.lit(True), "max_bank_energy_insufficient"),
        ),
        "discharge_code": code(
            (~el.non_negative(c("need_a")), "continuous_discharge_unknown"), forbidden, (c("unit_a").isNull(), "continuous_discharge_unknown"),
            (amps >= c("need_a"), "continuous_discharge_pass"), (more_amps, "continuous_discharge_insufficient"),
            (c("max_parallel") <= c("parallel"), "parallel_not_permitted"), (F.lit(True), "max_parallel_insufficient"),
        ),
        "surge_code": code(
            (no_surge, "surge_not_requested"), (~(el.non_negative(c("surge_a")) & el.non_negative(c("surge_s"))), "surge_incomplete"), forbidden,
            (c("peak_a").isNull(), "surge_unknown"), (c("surge_a") > peak, "surge_insufficient"), (c("peak_s").isNull(), "surge_duration_missing"),
            (c("surge_s") > c("peak_s"), "surge_duration_insufficient"), (F.lit(True), "surge_pass"),
        ),
    }
    out = banks.withColumns(codes)
    passing = ("voltage_requirement_pass", "energy_requirement_pass", "continuous_discharge_pass", "surge_pass", "surge_not_requested")
    open_ = ("topology_not_permitted", "voltage_requirement_invalid", "energy_requirement_invalid", "continuous_discharge_unknown", "surge_incomplete", "surge_unknown", "surge_duration_missing")
    failed = F.greatest(*[~c(x).isin(*passing, *open_) for x in codes])
    unsure = F.greatest(*[c(x).isin(*open_) for x in codes])
    return out.withColumn("severity", F.when(failed, F.lit("FAIL")).when(unsure, F.lit("CONDITIONAL")).otherwise(F.lit("PASS")))


def feasible_banks(units: DataFrame) -> DataFrame:
    """All permitted banks of the units that pass every check, for units with the columns of ``bank_checks`` (but series and
    parallel)."""
    return bank_checks(enumerate_banks(units)).where(F.col("severity") == "PASS")
