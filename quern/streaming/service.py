"""A running engine: its states, its queue and its memory of answers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import extract, store
from quern.operators.fulltext import SearchIndex
from quern.sources.scan import WATCHED, ignored, read_files
from quern.functions.text import extension

#: States and the states each may go over to.
MOVES = {"starting": ("initial_scan", "stopped"), "initial_scan": ("indexing", "idle", "stopped"), "indexing": ("idle", "stopped"), "idle": ("indexing", "stopped"), "stopped": ()}


@dataclass
class State:
    """The state of a service and since when it has been idle."""

    name: str = "starting"
    idle_seconds: float = 1_800.0
    clock: Callable[[], float] = time.monotonic
    touched: float = field(default=0.0)

    def __post_init__(self) -> None:
        self.touched = self.clock()

    def go(self, name: str) -> State:
        """Moves on; a move that is none raises an error."""
        if name not in MOVES[self.name]:
            raise ValueError(f"{self.name} does not lead to {name}")
        self.name, self.touched = name, self.clock()
        return self

    def touch(self) -> None:
        self.touched = self.clock()

    def expired(self) -> bool:
        """Whether nothing has happened for so long that the service should stop."""
        return self.name == "idle" and self.clock() - self.touched >= self.idle_seconds


@dataclass
class Remembered:
    """Answers of the last seconds by question; an answer is worked out when first asked for."""

    seconds: float = 30.0
    clock: Callable[[], float] = time.monotonic
    held: dict = field(default_factory=dict)

    def get(self, key: object, make: Callable[[], object]) -> object:
        now = self.clock()
        self.held = {k: v for k, v in self.held.items() if now - v[0] < self.seconds}
        if key not in self.held:
            self.held[key] = (now, make())
        return self.held[key][1]


def file_events(events: DataFrame, rules: tuple[str, ...], extensions: tuple[str, ...] = WATCHED) -> DataFrame:
    """The events (path, kind, ts) of source files that are not ignored and were added, modified or deleted."""
    return events.where(F.lower("kind").isin("add", "modified", "delete") & extension(F.col("path")).isin(list(extensions)) & ~ignored(F.col("path"), rules))


def next_timeout(pending: DataFrame, now: float, quiet: float = 2.0) -> DataFrame:
    """(seconds): how long until the first pending path (path, ts) has been quiet for long enough, -1 if none is pending."""
    left = F.greatest(F.lit(0.0), F.col("ts").cast("timestamp").cast("double") + quiet - now)
    return pending.agg(F.coalesce(F.min(left), F.lit(-1.0)).alias("seconds"))


def cold_start(files: DataFrame, ready: DataFrame) -> DataFrame:
    """(tick, language, path): one file of each language a tick, in the order of paths, once all languages of the files are ready.

    files: (path, language); ready: (language, ready).
    """
    known = files.where("language IS NOT NULL")
    waiting = known.select("language").distinct().join(ready.where("ready"), "language", "left_anti").limit(1)
    order = Window.partitionBy("language").orderBy("path")
    rows = known.withColumn("tick", F.row_number().over(order) - 1)
    return rows.join(waiting.select(F.lit(1).alias("_w")), F.lit(True), "left_anti").select("tick", "language", "path")


def backoff(attempts: int, most: float = 60.0) -> float:
    """Seconds to wait after so many failures in a row: doubling, up to a limit."""
    return float(min(2.0 ** max(attempts, 0), most))


def analysed(found: DataFrame) -> DataFrame:
    """(path, success, error, symbols_count, calls_count, cfg_count, dfg_count, content_hash) of files that were read.

    found: (path, language, content, content_hash, error). A file that cannot be read has its error and no hash.
    """
    counts = extract.facts(found).groupBy("path").pivot("fact", ["symbol", "call", "cfg", "dfg"]).agg(F.count(F.lit(1)))
    rows = found.select("path", "error", F.when(F.col("error").isNull(), F.col("content_hash")).alias("content_hash")).join(counts, "path", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return rows.select("path", F.col("error").isNull().alias("success"), "error", n("symbol").alias("symbols_count"), n("call").alias("calls_count"), n("cfg").alias("cfg_count"), n("dfg").alias("dfg_count"), "content_hash")


def reindexer(spark: SparkSession, root: str, folder: str, index: SearchIndex | None = None, prune_deleted: bool = False) -> Callable[[DataFrame], None]:
    """What a micro-batch of changed paths (path) does: the facts of these files are read anew and replace the stored ones.

    Facts are stored below ``folder`` by generation; ``stored_facts`` reads what counts. A file that is gone keeps
    its rows unless prune_deleted; one that fails is noted with its error and never stops the batch. A retried batch
    replaces the same files again.
    """

    def run(paths: DataFrame) -> None:
        found = read_files(spark, root, paths).persist()
        result = analysed(found).persist()
        done = result if prune_deleted else result.where("success")
        rows = extract.facts(found.where("content IS NOT NULL"))
        stamp = f"{time.time_ns():020d}"
        rows.write.mode("overwrite").parquet(f"{folder}/facts/gen={stamp}")
        result.withColumn("replaces", F.col("success") | F.lit(prune_deleted)).write.mode("overwrite").parquet(f"{folder}/analysed/gen={stamp}")
        if index is not None:
            symbols = extract.symbols_of(rows).select("symbol_id", F.xxhash64("path").alias("file_id"), "name", "signature", "documentation")
            index.update(symbols.dropDuplicates(["symbol_id"]), done.select(F.xxhash64("path").alias("file_id")))
        found.unpersist()
        result.unpersist()

    return run


def stored_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(facts, analyses) that count: of each path those of its last generation that replaces it."""
    runs = spark.read.parquet(f"{folder}/analysed").withColumn("gen", F.col("gen").cast("string"))
    last = store.upsert_latest(runs.where("replaces").select("path", "gen"), ["path"], [F.col("gen")])
    facts = spark.read.parquet(f"{folder}/facts").withColumn("gen", F.col("gen").cast("string"))
    newest = store.upsert_latest(runs, ["path"], [F.col("gen")])
    return facts.join(last, ["path", "gen"], "left_semi").drop("gen"), newest.drop("gen", "replaces")
