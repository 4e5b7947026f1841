"""Keeping fact tables current: upserts, per-file replacement, delete rules, id resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key: the newest by the given order. Combined inside the map tasks, so a hot key shuffles little."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("_s")).select(*keys, *[F.col("_s")[c].alias(c) for c in others])


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file_id") -> DataFrame:
    """The rows of changed files replaced by their new rows; changed: (file_id)."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade(rows: DataFrame, owner: str, deleted: DataFrame) -> DataFrame:
    """Rows whose owner is not deleted; deleted: (id)."""
    return rows.join(deleted.select(F.col("id").alias(owner)).distinct(), owner, "left_anti")


def set_null(rows: DataFrame, reference: str, deleted: DataFrame) -> DataFrame:
    """Rows with null in place of references to what is deleted; deleted: (id)."""
    gone = deleted.select(F.col("id").alias(reference), F.lit(True).alias("_gone")).distinct()
    cols = rows.columns
    return rows.join(gone, reference, "left").withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(*cols)


def resolve_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, callee_id): calls resolved within their file by name; of several symbols of a name the last by (line_start, id) wins."""
    last = symbols.groupBy("file_id", F.col("name").alias("callee_name")).agg(F.max_by("id", F.struct("line_start", "id")).alias("callee_id"))
    return calls.select("id", "file_id", "callee_name").join(last, ["file_id", "callee_name"], "left").select("id", "callee_id")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): paths whose hash differs, are new, or are gone. old, new: (path, content_hash)."""
    both = old.select("path", F.col("content_hash").alias("a"), F.lit(1).alias("_o")).join(new.select("path", F.col("content_hash").alias("b"), F.lit(1).alias("_n")), "path", "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")
