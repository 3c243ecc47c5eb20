"""Sessions: cores and heap by precedence, and defaults fit for large inputs."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def memory_mb(text: str) -> int:
    """Whole megabytes of 512m, 4g, 2048k or a bare number of bytes."""
    t = text.strip().lower().removesuffix("b")
    unit = {"k": 1 / 1024, "m": 1.0, "g": 1024.0}.get(t[-1:], None)
    try:
        return math.floor(float(t[:-1]) * unit) if unit else math.floor(float(t) / (1024 * 1024))
    except ValueError:
        raise ValueError(f"not a memory size: {text!r}") from None


def total_memory_mb() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // (1024 * 1024)


def resolve_cores(cores: int | None = None) -> int:
    """SLOTS_OVERRIDE, else the argument, else all of the machine's."""
    override = os.environ.get("SLOTS_OVERRIDE")
    return max(1, int(override)) if override else max(1, cores) if cores else os.cpu_count() or 1


def resolve_heap_mb(heap: str | None = None, workers: int | None = None, fraction: float = 0.75) -> int:
    """SPARK_DRIVER_MEMORY, else the argument, else a share of the machine's memory (512 MB at least for each of several)."""
    given = os.environ.get("SPARK_DRIVER_MEMORY") or heap
    if given:
        return memory_mb(given)
    whole = total_memory_mb() * fraction
    return max(512, int(whole / workers)) if workers else int(whole)


def baseline_heap_gb(threads: int, total_gb: float) -> int:
    return max(2, min(math.ceil(0.5 + 0.25 * threads), int(0.8 * total_gb)))


def build_session(app: str = "tessera", cores: int | None = None, heap: str | None = None, **conf: str) -> SparkSession:
    """A local session, or under spark-submit the one that it describes.

    spark-submit's settings win, its master and resources are never touched, and only what is unset is filled in.
    Explicit ``conf`` wins over defaults, and over spark-submit where it names what that left unset.  A local session
    gets a folder for staged tables; on a cluster ``spark.checkpoint.dir`` must name a shared one.
    """
    n = resolve_cores(cores)
    b = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    given = submitted()
    if given is None:
        master = conf.get("spark.master") or os.environ.get("MASTER") or f"local[{n}]"
        defaults |= {"spark.master": master, "spark.driver.memory": f"{resolve_heap_mb(heap)}m", "spark.ui.enabled": "false"}
        if master.startswith("local"):
            defaults |= {"spark.sql.shuffle.partitions": str(2 * n), "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "tessera-checkpoints")}
    for k, v in settings(defaults, conf, given or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def submitted() -> dict[str, str] | None:
    """The settings of spark-submit, or None if this process was not started by it."""
    return dict(SparkConf().getAll()) if os.environ.get("PYSPARK_GATEWAY_PORT") else None


def settings(defaults: dict[str, str], conf: dict[str, str], given: dict[str, str]) -> dict[str, str]:
    """What to set: ``conf`` over ``defaults``, less whatever is ``given`` already."""
    return {k: v for k, v in {**defaults, **conf}.items() if k not in given}
