"""Streaming forms: windowed envelopes with late data, and the stored amount as per-key state."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_envelope(events: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Per key and event-time window: the largest value, the known sum, and how many values are unknown.  Events later
    than ``late`` behind the newest are dropped by the watermark."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(F.window(ts, width), key)
        .agg(
            F.max(value).alias("max_value"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias("known"),
            F.count_if(F.col(value).isNull()).alias("unresolved"),
        )
        .select(F.col("window.start").alias("start"), key, "max_value", "known", "unresolved")
    )


def stored_energy_stream(events: DataFrame, key: str, order: list[str], energy: str, start: float, low: float, high: float) -> DataFrame:
    """Per key and batch: the stored amount after its events, the totals curtailed and unmet so far, and how many events
    had an unknown request.

    As in the batch form, the amount is unknown from the first unknown request on, and the totals stay those of the events before.
    State is three numbers and a count per key.  Events of one batch are applied in ``order``; a batch arrives in order
    of time, as the amount depends on it.
    """
    names = [key, "stored_wh", "curtailed_wh", "unmet_wh", "unresolved"]
    out = f"{key} long, stored_wh double, curtailed_wh double, unmet_wh double, unresolved long"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, curtailed, unmet, unresolved = state.get if state.exists else (start, 0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for e in rows[energy]:
            if pd.isna(e):
                unresolved += 1
            elif not unresolved:
                curtailed += max(0.0, x + e - high)
                unmet += max(0.0, low - x - e)
                x = min(high, max(low, x + e))
        state.update((x, curtailed, unmet, unresolved))
        stored = None if unresolved else x
        yield pd.DataFrame([(keys[0], stored, curtailed, unmet, unresolved)], columns=names).astype({"stored_wh": "float64"})

    return events.groupBy(key).applyInPandasWithState(
        step, out, "x double, curtailed double, unmet double, unresolved long", "update", GroupStateTimeout.NoTimeout
    )


def versioned_log_stream(
    log: DataFrame, key: str, order: list[str], id_col: str, expected: str, state: str, transitions: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``key, id, outcome, version`` of every write, as ``histories.versioned_log`` has them.

    State per key is the current write, its state and its version.  Writes of one batch are applied in ``order``; batches arrive
    in order of it.  Keys and ids are whole numbers; ids are kept as text, as pandas has nulls in doubles only.
    """
    allowed = {before: set(after) for before, after in transitions.items()}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        current, now, version = kept.get if kept.exists else (None, "", 0)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for write, wanted, to in zip(rows[id_col], rows[expected], rows[state], strict=True):
            if wanted != current:
                out.append((keys[0], write, "conflict", None))
            elif to not in allowed.get(now, ()):
                out.append((keys[0], write, "illegal", None))
            else:
                current, now, version = str(write), to, version + 1
                out.append((keys[0], write, "accepted", version))
        kept.update((current, now, version))
        yield pd.DataFrame(out, columns=[key, id_col, "outcome", "version"]).astype({"version": "Int64"})

    named = [F.col(c) for c in dict.fromkeys([key, id_col, state, *order])]
    return log.select(*named, F.col(expected).cast("string").alias(expected)).groupBy(key).applyInPandasWithState(
        step, f"{key} long, {id_col} long, outcome string, version long", "current string, now string, version long", "append", GroupStateTimeout.NoTimeout
    )
