"""Status lattices: ordered ranks instead of booleans, each with its own meaning of the empty set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Worst first; ranks are fixed values.
SEVERITY = {"FAIL": 4, "CONDITIONAL": 3, "WARNING": 2, "PASS": 1, "INFORMATION": 1}
ELIGIBILITY = {"BLOCKED": 3, "UNRESOLVED": 2, "ELIGIBLE": 1}
GATE = {"NO": 3, "UNKNOWN": 2, "YES": 1}
COMPATIBILITY = {"incompatible": 3, "unknown": 2, "compatible": 1}
POLICY_ACTION = {"none": 0, "inform": 1, "caution": 2, "suppress_recommendation": 3, "exclude": 4}
ADVISORY_SEVERITY = {"informational": 0, "low": 1, "moderate": 2, "high": 3, "critical": 4}
CONFIDENCE = {"low": 0, "medium": 1, "high": 2, "confirmed": 3}


def rank(status: Column, lattice: dict[str, int]) -> Column:
    """The rank of a status; null for an unknown name."""
    out = F.lit(None).cast("int")
    for name, value in lattice.items():
        out = F.when(status == name, F.lit(value)).otherwise(out)
    return out


def name(value: Column, lattice: dict[str, int], empty: str) -> Column:
    """The status of a rank, the first that has it; ``empty`` for null."""
    out = F.lit(empty)
    for status, r in reversed(list(lattice.items())):
        out = F.when(value == r, F.lit(status)).otherwise(out)
    return out


def worst(status: Column, lattice: dict[str, int], empty: str) -> Column:
    """Aggregate: the worst status of a group; ``empty`` where the group has none."""
    return name(F.max(rank(status, lattice)), lattice, empty)


def worst_of(statuses: list[Column], lattice: dict[str, int], empty: str) -> Column:
    """The worst of several statuses of a row; nulls don't count."""
    ranks = [rank(s, lattice) for s in statuses]
    return name(F.greatest(*ranks) if len(ranks) > 1 else ranks[0], lattice, empty)
