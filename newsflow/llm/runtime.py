"""Plumbing that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.ship import ship_package
from newsflow.tables import components, materialize, n_parts, new_path, scratch, shared_dir, small_batches

__all__ = ["components", "drop_kept", "free_name", "kept", "materialize", "n_parts", "new_path", "release_memory", "scratch", "shared_dir", "ship_package", "small_batches", "without_ids"]

#: Up to so many ids (8 bytes each) are sent to every executor; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def release_memory() -> None:
    """Gives what this Python worker has freed back to the system: workers outlive their tasks, and idle ones count as memory of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What operators keep in a worker between tasks: by name, a function that drops it.
kept: dict[str, Callable[[], None]] = {}


def drop_kept(but: str = "") -> None:
    """At the start of a task: what other operators' tasks kept in this worker goes."""
    for name, drop in kept.items():
        if name != but:
            drop()
    release_memory()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores after it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_ids(df: DataFrame, key: str, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``df`` without the rows whose ``key`` is in the one-column ``ids``; rows of a null key stay, as do all other columns."""
    gone = free_name(df, "_gone")
    ids = materialize(ids.toDF(gone).where(F.col(gone).isNotNull()).distinct(), "ids")
    if ids.count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(key) == F.col(gone), "left_anti")
