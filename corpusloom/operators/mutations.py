"""Upserts, change capture and set operations on keyed tables, as joins that give a new table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row per key: the latest delivered. Partial maxima per task, so a hot key costs one row a task.

    Ties are broken by the other columns, so the result is defined. Rows with a null key are dropped.
    """
    rest = [c for c in df.columns if c not in (*keys, time)]
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("_last")).select(*keys, "_last.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], supplied: Sequence[str]) -> DataFrame:
    """Old rows with the supplied columns of new rows; rows only in new are added. Other columns keep their old values."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in supplied]).withColumn("_in_new", F.lit(True))
    joined = old.join(fresh, list(keys), "full_outer")
    return joined.select(*[F.when(F.col("_in_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns])


def one_row(df: DataFrame, none_allowed: bool = False):
    """The only row; an error if there is none (unless allowed: null then) or more than one. Two rows at most come to the driver."""
    rows = df.limit(2).collect()
    if len(rows) > 1 or not (rows or none_allowed):
        raise ValueError(f"{'more than one row' if rows else 'no row'} where one is due")
    return rows[0] if rows else None


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and those new rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The children of rows that stay."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def captured_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed, unchanged or stale, by a digest; nulls compare as values."""
    a = old.select(key, F.col(digest).alias("_old")).withColumn("_in_old", F.lit(True))
    b = new.select(key, F.col(digest).alias("_new")).withColumn("_in_new", F.lit(True))
    change = (
        F.when(F.col("_in_old").isNull(), "new")
        .when(F.col("_in_new").isNull(), "stale")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def replaced(array: str, pairs: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """df with the elements of an array column renamed by pairs (old, new); order is kept, unknown elements stay, repeated rows too."""
    once = df.select(key, array).where(F.size(array) > 0).distinct()
    spread = once.select(key, F.col(array).alias("_array"), F.posexplode(array).alias("_at", "old")).join(pairs, "old", "left")
    renamed = spread.groupBy(F.col(key).alias("_key"), "_array").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new", "old").alias("v")))).alias("_items"))
    joined = df.join(renamed, df[key].eqNullSafe(F.col("_key")) & (df[array] == F.col("_array")), "left")
    kept = [F.coalesce(F.transform("_items", lambda x: x["v"]), df[array]).alias(c) if c == array else df[c] for c in df.columns]
    return joined.select(*kept)


def updated(df: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """df with the values set in the rows whose key is among the keys given."""
    marked = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def replaced_children(children: DataFrame, deleted: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """The children of rows that stay, and the fresh ones of those that went."""
    return delete_cascade(children, deleted, key).unionByName(fresh.join(deleted.select(key).distinct(), key, "left_semi"))


def revisions(rows: DataFrame, key: str, version: str, edited: Column, change: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows after the edit, history): edited rows get the change and the next version; the history holds them as they were."""
    after = rows.select(
        *[F.when(edited, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.when(edited, F.coalesce(c, F.lit(0)) + 1).otherwise(F.col(c)).alias(c) if c == version else F.col(c) for c in rows.columns]
    )
    return after, rows.where(edited)


def erased(df: DataFrame, which: Column, blanked: Sequence[str], hashed: Sequence[str]) -> DataFrame:
    """Personal texts of the rows which are true set null, or replaced by ``sha256:`` and their hash."""
    change = {c: F.when(which, F.lit(None)).otherwise(F.col(c)) for c in blanked}
    change |= {c: F.when(which, F.concat(F.lit("sha256:"), F.sha2(F.col(c), 256))).otherwise(F.col(c)) for c in hashed}
    return df.withColumns(change)
