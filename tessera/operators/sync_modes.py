"""The seven ways in which shards' models are brought together, their other names, and what each exchanges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SyncMode:
    name: str
    pattern: str
    averages: bool
    ordered_log: bool


NONE, QUEUE, FEDAVG, ALLREDUCE = "none", "ps_sync_fedavg_queue", "ps_sync_fedavg_mpi", "allreduce_mpi"
ASYNC, HYBRID, GOSSIP = "ps_async", "hybrid_ps_allreduce", "gossip"
DEFAULT = FEDAVG

MODES = {
    m.name: m
    for m in (
        SyncMode(NONE, "independent", False, False), SyncMode(QUEUE, "averaging each round", True, False), SyncMode(FEDAVG, "averaging each round", True, False),
        SyncMode(ALLREDUCE, "exact global step", False, False), SyncMode(ASYNC, "ordered blending", False, True), SyncMode(HYBRID, "dense sum and scalar mean", True, False),
        SyncMode(GOSSIP, "ring neighbours", True, False),
    )
}
# The names that callers may use for each mode.
ALIASES = {
    "none": NONE,
    "no_sync": NONE,
    "queue": QUEUE,
    "fedavg_queue": QUEUE,
    "mpi_fedavg": FEDAVG,
    "fedavg_mpi": FEDAVG,
    "mpi": ALLREDUCE,
    "allreduce": ALLREDUCE,
    "async": ASYNC,
    "async_ps": ASYNC,
    "hybrid": HYBRID,
    "decentralized": GOSSIP,
}


def normalise(name: str | None) -> str:
    """The mode's own name; None gives the default and an unknown name a ValueError."""
    if name is None:
        return DEFAULT
    key = name.strip().lower()
    found = key if key in MODES else ALIASES.get(key)
    if found is None:
        raise ValueError(f"unknown sync mode {name!r}; known: {', '.join(MODES)}")
    return found


def descriptor(name: str | None) -> SyncMode:
    """What a mode exchanges, by any of its names."""
    return MODES[normalise(name)]


def exchanges(name: str | None) -> bool:
    """Whether a mode's shards exchange models while they train (all but independent ones and the driver's queue do so directly)."""
    return normalise(name) not in (NONE, QUEUE)


def frame(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.pattern, m.averages, m.ordered_log) for m in MODES.values()]
    return spark.createDataFrame(rows, "mode string, pattern string, averages boolean, ordered_log boolean")


def alias_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted([*ALIASES.items(), *((m, m) for m in MODES if m not in ALIASES)]), "alias string, mode string")
