"""Snapshot store updates as table operations (no in-place mutation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDITABLE = ("name", "description", "tags")


def update_snapshots(snapshots: DataFrame, updates: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """SNP_UPDATE: name, description, tags change only where the update gives a value (left join + coalesce)."""
    cols = [c for c in EDITABLE if c in updates.columns and c in snapshots.columns]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = snapshots.join(u, key, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_u_{c}"), F.col(c))).drop(f"_u_{c}")
    return j


def delete_snapshots(snapshots: DataFrame, tombstones: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """SNP_DELETE: remove snapshots named in a tombstone table (left anti join)."""
    return snapshots.join(tombstones.select(key), key, "left_anti")
