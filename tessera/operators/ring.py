"""Neighbours on a ring of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbours(place: int, size: int, fanout: int | None = None) -> list[int]:
    """Distinct places at ring distances 1 to ``fanout`` (1 if None, half the ring at most), nearer ones and the right one first."""
    reach = max(1, min(1 if fanout is None else int(fanout), size // 2)) if size > 1 else 0
    return list(dict.fromkeys((place + side * d) % size for d in range(1, reach + 1) for side in (1, -1)))


def neighbour_frame(shards: DataFrame, size: int, fanout: int | None = None, shard: str = "shard") -> DataFrame:
    """``shard, peer`` rows; the list per shard is a parameter's size."""
    reach = max(1, min(1 if fanout is None else int(fanout), size // 2)) if size > 1 else 0
    if not reach:
        return shards.select(shard, F.col(shard).alias("peer")).where("false")
    steps = [side * d for d in range(1, reach + 1) for side in (1, -1)]
    peers = F.array_distinct(F.array(*[F.pmod(F.col(shard) + s, F.lit(size)) for s in steps]))
    return shards.select(shard, F.explode(peers).alias("peer"))
