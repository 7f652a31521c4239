"""Moving tuples from the fullest to the emptiest partition.

Which partition gives how much to which follows from the counts alone, so the
plan is made on the driver from n numbers; the rows only change their rid.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_to_int
from ..scratch import materialized
from .dedup import numbered_tuples


@dataclass(frozen=True)
class Move:
    """n tuples with the highest addresses go from hot to cold; skew before and after."""

    hot: int
    cold: int
    n: int
    before: float
    after: float


def _skew(counts: Mapping[int, int]) -> float:
    total = sum(counts.values())
    return (max(counts.values()) - min(counts.values())) * len(counts) / total if total else 0.0


def planned_moves(counts: Mapping[int, int], threshold: float = 0.5, most: int = 10) -> list[Move]:
    """Moves until the skew is at most threshold, the fullest is within one of the mean, or ``most`` are made.

    Each gives half of what the fullest holds above the mean (rounded down) to
    the emptiest; lower rids win ties.
    """
    now, moves = dict(sorted(counts.items())), []
    mean = sum(now.values()) // max(1, len(now))
    while len(moves) < most and _skew(now) > threshold:
        hot, cold = max(now, key=lambda r: (now[r], -r)), min(now, key=lambda r: (now[r], r))
        n = (now[hot] - mean) // 2
        if now[hot] <= mean + 1 or n <= 0:
            break
        before = _skew(now)
        now[hot] -= n
        now[cold] += n
        moves.append(Move(hot, cold, n, before, _skew(now)))
    return moves


def rebalanced(routed: DataFrame, n: int, threshold: float = 0.5, most: int = 10, written: bool = False) -> tuple[DataFrame, list[Move]]:
    """routed with the rids after all moves, and the moves.

    Addresses of one number leave in descending order of site.  Afterwards rid
    no longer follows from the address: remove repeats by address, not by rid.
    The tuples of all partitions that give are numbered and written once; only a
    partition that gives after it has received is numbered anew.  routed is
    written first unless it is read from a table already (``written``), as a
    condition on rid would else be pushed below whatever made it, down to a scan.
    """
    routed = routed if written else materialized(routed, "routed")
    counts = dict.fromkeys(range(n), 0) | {r["rid"]: r["count"] for r in routed.groupBy("rid").count().collect()}
    moves, out = planned_moves(counts, threshold, most), routed
    left = list(moves)
    while left:
        out, left = _moved(out, counts, left)
    return out, moves


def _moved(routed: DataFrame, counts: dict[int, int], moves: list[Move]) -> tuple[DataFrame, list[Move]]:
    """routed after the leading moves that one numbering serves, and the other moves; counts follow."""
    rid, rn = F.col("rid"), F.col("rn")
    new, received, giving, k = rid, set(), set(), 0
    for m in moves:
        if m.hot in received:
            break
        new = F.when((rid == m.hot) & (rn > counts[m.hot] - m.n) & (rn <= counts[m.hot]), F.lit(m.cold)).otherwise(new)
        counts[m.hot] -= m.n
        received.add(m.cold)
        giving.add(m.hot)
        k += 1
    for m in moves[:k]:
        counts[m.cold] += m.n
    keyed = routed.withColumn("__ipn", ip_to_int(F.col("ip")))
    numbered = numbered_tuples(keyed.where(rid.isin(*giving)), ("__ipn", "site_id", "ip")).withColumn("rid", new)
    rest = keyed.where(~rid.isin(*giving))
    return rest.drop("__ipn").unionByName(numbered.drop("rn", "__ipn")), moves[k:]


def steal_stats(moves: list[Move]) -> dict[str, float]:
    """Number of moves, tuples moved, skew before the first and after the last."""
    return {"total_steals": len(moves), "total_items_moved": sum(m.n for m in moves), "skew_before_first": moves[0].before if moves else 0.0, "skew_after_last": moves[-1].after if moves else 0.0}
