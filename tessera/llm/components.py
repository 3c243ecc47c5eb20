"""Connected components of links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, unstage

#: A key of more than one in so many rows has its rows joined where they lie.
HOT = 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def join_sized(rows: DataFrame, sized: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``sized`` (one row for each ``key``, ``__n`` its number among the ``total`` rows).

    A key of over a thousandth of all rows may be too many for one task.  There are fewer than a thousand such keys,
    so their values are sent to every task and their rows stay where they are; all others are dealt by key.
    """
    bound = max(1, total // HOT)
    more = F.struct(*[c for c in sized.columns if c not in (key, "__n")])
    hot = F.broadcast(sized.where(F.col("__n") > bound).select(F.col(key).alias("__key"), more.alias("__more")))
    marked = rows.join(hot, F.col(key) == F.col("__key"), "left").drop("__key")
    cold = marked.where("__more is null").drop("__more").join(sized.where(F.col("__n") <= bound).select(key, more.alias("__more")), key, how)
    return marked.where("__more is not null").select(*rows.columns, "__more.*").unionAll(cold.select(*rows.columns, "__more.*"))


def joined_least(links: DataFrame, total: int) -> DataFrame:
    """Links (``a, b`` and others) with ``m``, the least ``b`` of each ``a``."""
    return join_sized(links, links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")), "a", total)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component`` (the least id reachable) of every end of ``edges`` (``a, b``), by alternating large and small stars.

    Each step is an aggregation and a join back, so a centre of many links is pre-aggregated; links of the few largest
    centres are not dealt by centre.  Rounds follow the logarithm of a component's size, not its diameter; an error
    is raised should ``max_rounds`` not do.  Each round is written to the shared folder, and the one before is
    deleted.  Null ends and loops are ignored; an empty table gives no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stage(edges)
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: greater neighbours go to the least of a node and its neighbours.
        large = joined_least(both, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")
        held = stage(large.distinct())
        # Small star: a node and its lesser neighbours go to the least of them.
        small = joined_least(held, state[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        following = stage(small.where("a <> b").distinct())
        unstage(held)
        unstage(edges)
        edges = following
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.groupBy("a").agg(F.min("b").alias("component"))
    return out.select(F.col("a").alias("id"), "component").unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
