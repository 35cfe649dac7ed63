"""Guarded formulas: null instead of a failure, and a code column that says why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def non_negative(x: Column) -> Column:
    return finite(x) & (x >= 0)


def positive(x: Column) -> Column:
    return finite(x) & (x > 0)


def efficiency(x: Column) -> Column:
    return positive(x) & (x <= 1)


def normalized(x: Column) -> Column:
    """Twelve decimals, and no negative zero."""
    r = F.round(x, 12)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def power_to_current(power: Column, voltage: Column) -> Column:
    return F.when(non_negative(power) & positive(voltage), power / voltage)


def current_to_power(current: Column, voltage: Column) -> Column:
    return F.when(non_negative(current) & positive(voltage), current * voltage)


def converted_current(power: Column, voltage: Column, eta: Column) -> Column:
    return F.when(non_negative(power) & positive(voltage) & efficiency(eta), power / eta / voltage)


def battery_side_power(supply: Column, power: Column, inverter: Column, converter: Column, load_v: Column, battery_v: Column) -> Column:
    """Power drawn from the battery.  AC needs an inverter efficiency; DC uses a converter efficiency where given, and
    without one is unresolved (null) if load and battery voltage differ."""
    ac = F.when(efficiency(inverter), power / inverter)
    differs = F.coalesce(load_v, battery_v) != battery_v
    dc = F.when(converter.isNotNull(), F.when(efficiency(converter), power / converter)).when(
        ~F.coalesce(differs, F.lit(False)), power
    )
    return F.when(F.coalesce(supply, F.lit("dc")) == "ac", ac).otherwise(dc)


def round_trip(length: Column, both_ways: Column) -> Column:
    return F.when(F.coalesce(both_ways, F.lit(True)), length * 2).otherwise(length)


def conductor(current: Column, length: Column, ohm_per_m: Column, nominal: Column) -> Column:
    """Struct of resistance, voltage drop, power loss and percent drop."""
    r = length * ohm_per_m
    return F.struct(
        r.alias("resistance_ohm"),
        (current * r).alias("voltage_drop_v"),
        (current * current * r).alias("power_loss_w"),
        F.when(positive(nominal), current * r / nominal * 100).alias("percent_drop"),
    )


def temperature_voltage(series: Column, reference_v: Column, beta: Column, cell_c: Column, reference_c: Column, uncertainty: Column, upper: bool) -> Column:
    """Ns * Vref * (1 + beta (T - Tref)) * (1 +- u); a non-positive result is unresolved."""
    v = series * reference_v * (1 + beta * (cell_c - reference_c)) * (1 + (uncertainty if upper else -uncertainty))
    return F.when(v > 0, v)


def awg_area_mm2(gauge: Column) -> Column:
    """Cross-section of a gauge index (1/0 is 0, 2/0 is -1, ...), from the wire diameter 0.127 mm * 92**((36 - n) / 39)."""
    d = 0.127 * F.pow(F.lit(92.0), (36 - gauge) / 39.0)
    return F.pi() / 4 * d * d
