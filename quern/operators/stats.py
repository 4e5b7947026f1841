"""Overview and pipeline statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(n_files, n_symbols)."""
    return files.agg(F.count(F.lit(1)).alias("n_files")).crossJoin(symbols.agg(F.count(F.lit(1)).alias("n_symbols")))  # one row each


def language_breakdown(files: DataFrame) -> DataFrame:
    """(language, n), most files first; null and empty languages are left out."""
    return files.where("language IS NOT NULL AND language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def latency(samples: DataFrame, order: list[Column], window: int = 100) -> DataFrame:
    """(sample_count, p50, p95, p99) of the last samples (column v), by index into the sorted window: n*q div 100."""
    last = samples.orderBy(*order).limit(window)
    arr = last.agg(F.array_sort(F.collect_list("v")).alias("s")).withColumn("n", F.size("s"))  # at most ``window`` samples
    at = lambda q: F.get(F.col("s"), F.least(F.col("n") - 1, F.expr(f"n * {q} div 100").cast("int")))
    return arr.select(F.col("n").cast("bigint").alias("sample_count"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


def embedding_stats(samples: DataFrame, order: list[Column], window: int = 100) -> DataFrame:
    """(sample_count, p50, p95, p99, avg_ms, throughput, health): the window's percentiles, and mean and rate over all samples (column v, nanoseconds).

    health is 'slow' where at least ten samples have a median over 20 ms.
    """
    total = samples.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("t"))  # one row
    rows = latency(samples, order, window).crossJoin(F.broadcast(total))
    slow = (F.col("sample_count") >= 10) & (F.col("p50") > 20_000_000)
    avg = F.when(F.col("n") > 0, F.col("t") / F.col("n") / 1e6).otherwise(0.0)
    rate = F.when(F.col("t") > 0, F.col("n") * 1e9 / F.col("t")).otherwise(0.0)
    return rows.select("sample_count", "p50", "p95", "p99", avg.alias("avg_ms"), rate.alias("throughput"), F.when(slow, "slow").otherwise("ok").alias("health"))


def index_health(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """(stored, indexed, delta, health, message): degraded if the counts differ by more than 10 and by more than a twentieth of the stored rows."""
    rows = stored.agg(F.countDistinct("id").alias("stored")).crossJoin(indexed.agg(F.count(F.lit(1)).alias("indexed")))  # one row each
    delta = F.abs(F.col("indexed") - F.col("stored"))
    bad = (delta > F.greatest(F.lit(10), F.expr("stored * 5 div 100"))) & ((F.col("stored") > 0) | (F.col("indexed") > 0))
    return rows.select("stored", "indexed", delta.alias("delta"), F.when(bad, "degraded").otherwise("ok").alias("health"), F.when(bad, F.format_string("INDEX_INCONSISTENT: faiss=%d sqlite=%d (delta=%d)", "indexed", "stored", delta)).alias("message"))


def crash_window(events: DataFrame, key: str, seconds: int = 180, most: int = 5) -> DataFrame:
    """(key, event_id, n, unavailable): events of a key within the last seconds up to each, and whether they are too many."""
    # a window of two cells of time: no task holds more of a hot key than two cells
    cells = events.withColumn("_cell", F.floor(F.col("sec") / (seconds + 1)))
    both = cells.withColumn("_own", F.lit(True)).unionByName(cells.withColumn("_cell", F.col("_cell") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_cell").orderBy("sec").rangeBetween(-seconds, 0)
    return both.withColumn("n", F.count(F.lit(1)).over(w)).where("_own").select(key, "event_id", "n", (F.col("n") >= most).alias("unavailable"))
