"""Changes to keyed tables as new tables: appending, replacing, deleting with what depends on them, and growing a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qa import latest_of


def upsert(base: DataFrame, changed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, of each key the one that is last by ``order``; on a tie the changed one."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changed.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_of(both, keys, [order, "_new"]).drop("_new")


def delete_cascade(parents: DataFrame, key: str, condition: Column, *children: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """The parents without those that meet the condition, and the children without those of a deleted parent; a condition
    that is null deletes nothing."""
    gone = parents.where(F.coalesce(condition, F.lit(False))).select(key).distinct()
    kept = [c.join(gone.withColumnRenamed(key, "_gone"), F.col(foreign) == F.col("_gone"), "left_anti") for c, foreign in children]
    return (parents.join(gone, key, "left_anti"), *kept)


def grow(table: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The table with the columns it lacks, filled with defaults; nulls in columns it has stay."""
    for name, value in defaults.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(value))
    return table


def update(base: DataFrame, changes: DataFrame, key: str, allowed: list[str], clamp: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``base`` with the values of ``changes`` (one row for each key) in the allowed columns that it has; a null there changes
    nothing, other columns and unknown keys are ignored, and clamped columns are brought between their bounds."""
    named = [c for c in allowed if c in changes.columns and c in base.columns]
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in named))
    both = base.join(new, F.col(key) == F.col("_key"), "left")
    for c in named:
        value = F.col(f"_new_{c}").cast(base.schema[c].dataType)
        if c in (clamp or {}):
            low, high = clamp[c]
            value = F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)).cast(base.schema[c].dataType))
        both = both.withColumn(c, F.coalesce(value, F.col(c)))
    return both.select(*base.columns)


def ages(table: DataFrame, now: float, heartbeat: str = "heartbeat_at", updated: str = "updated_at") -> tuple[Column, Column]:
    """Seconds since the last sign of life (a heartbeat of 0 or null counts as none: then since the last change), and since
    the last change; never negative."""
    changed = F.coalesce(F.col(updated), F.lit(0.0))
    alive = F.coalesce(F.when(F.col(heartbeat) != 0, F.col(heartbeat)), changed)
    return F.greatest(F.lit(0.0), F.lit(now) - alive), F.greatest(F.lit(0.0), F.lit(now) - changed)


def health(table: DataFrame, now: float, active: tuple[str, ...] = ("running", "pausing"), silent: float = 10, slow: float = 120) -> DataFrame:
    """``table`` with the ages to a tenth of a second, ``health_state`` and ``is_stalled``; ``now`` is given, so a result can be repeated."""
    alive, changed = ages(table, now)
    busy = F.col("status").isin(*active)
    state = F.when(busy & (alive > silent), "worker_unresponsive").when(busy & (changed > slow), "long_running").when(busy, "working").otherwise(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown")))
    out = table.withColumns({"heartbeat_age_seconds": F.bround(alive, 1), "progress_age_seconds": F.bround(changed, 1), "health_state": state})
    return out.withColumn("is_stalled", F.col("health_state").isin("worker_unresponsive", "long_running"))


def expired(table: DataFrame, now: float, days: int, ended: tuple[str, ...]) -> Column:
    """Rows that ended and have not changed for so many days (one at least); false where that is unknown."""
    return F.coalesce((F.col("updated_at") < F.lit(now - max(1, days) * 86400.0)) & F.col("status").isin(*ended), F.lit(False))
