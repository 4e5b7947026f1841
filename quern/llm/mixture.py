"""Mixing sources to target weights (problem 9) by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.tables import cut_lineage

#: Residual units one task of the reduction tree takes per source.
FAN_IN = 64
_DECIDED = "source string, doc_id bigint, n_tokens bigint, base int, extra int, p double, part int"


def _uniform(ids: np.ndarray, level: int, seed: int) -> np.ndarray:
    """One number in [0, 1) for each id: a hash, so that a retried task draws the same."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + level * 7919 + 1) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of probabilities in [0, 1] in the given order: 0/1 outcomes and the index of the unit left open, or -1.

    Two units at a time: mass moves from one to the other, at random and keeping both expectations, until one
    of them is 0 or 1. The sum of all probabilities is kept, so what stays open is one unit with a fraction.
    """
    out = np.where(p >= 1.0, 1.0, 0.0)
    held, mass = -1, 0.0
    for i in np.flatnonzero((p > 0.0) & (p < 1.0)):
        if held < 0:
            held, mass = i, p[i]
            continue
        a, b = mass, p[i]
        if a + b < 1.0:
            loser, winner, rest = (i, held, a + b) if u[i] < a / (a + b) else (held, i, a + b)
            out[loser], held, mass = 0.0, winner, rest
        else:
            winner, other, rest = (held, i, a + b - 1.0) if u[i] < (1.0 - b) / (2.0 - a - b) else (i, held, a + b - 1.0)
            out[winner], held, mass = 1.0, other, rest
        if mass < 1e-12 or mass > 1.0 - 1e-12:
            out[held], held = round(mass), -1
    if held >= 0:
        out[held] = mass
    return out, int(held)


def _round(level: int, seed: int, last: bool):
    """Rounds the units of each source within a batch of rows; the open unit of each keeps its fraction in p."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "n_tokens", "doc_id"], kind="stable")
        done = []
        for _, g in rows.groupby("source", sort=False):
            p = g["p"].to_numpy(np.float64, copy=True)
            u = _uniform(g["doc_id"].to_numpy(), level, seed)
            out, held = pivot(p, u)
            if last and held >= 0:
                out[held], held = float(u[held] < out[held]), -1
            open_ = np.zeros(len(p), bool)
            if held >= 0:
                open_[held] = True
            done.append(g.assign(extra=np.where(open_, -1, out.round()).astype(np.int32), p=np.where(open_, out, 0.0)))
        return pd.concat(done) if done else rows

    return f


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares). documents: (doc_id, source, n_tokens); targets: (source, weight, max_repeats).

    mixture has a row (source, doc_id, n_tokens, copies) for each document taken at least once. shares has a
    row for each target: its weight, the share it should have among the sources that have tokens, its actual
    share, tokens and documents.

    The whole is ``total`` tokens, or the most at which every source that has tokens can hold its share: the
    smallest of max_repeats * tokens / share. Each document of a source gets the same fractional number of
    copies, at most max_repeats; the whole part is certain, the fraction is rounded. Fractions are paired
    inside each task first, sorted by size so that what one gains the other loses is nearly the same number of
    tokens; the open unit of each task and source goes up a tree of tasks of ``fan_in`` units each; only the
    root rounds its last unit by a draw. Draws are hashes of the doc_id: any retry decides alike.

    Repeated doc_ids count once. Documents of unlisted or null sources are left out, and so are texts without
    tokens. Listed sources without documents or weight have share 0 and their weight goes to the others in
    proportion. Empty tables give no mixture.
    """
    docs = documents.select("doc_id", "source", "n_tokens").where("n_tokens > 0 AND source IS NOT NULL").dropDuplicates(["doc_id"])
    docs = cut_lineage(docs)
    target = targets.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).where("source IS NOT NULL")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = target.join(sizes, "source", "left").fillna(0, ["tokens", "docs", "weight", "max_repeats"])
    every = Window.partitionBy(F.lit(1))  # one row per target
    has = (F.col("tokens") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0)
    plan = plan.withColumn("share", F.when(has, F.col("weight") / F.sum(F.when(has, F.col("weight"))).over(every)).otherwise(0.0))
    most = F.min(F.when(has, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(every)
    whole = most if total is None else F.lit(float(total))
    copies = F.when(has, F.least(F.col("share") * F.col("whole") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    plan = cut_lineage(plan.withColumn("whole", whole).withColumn("copies", copies))

    def rounded(df: DataFrame, level: int, last: bool, keys: list[str] | None) -> DataFrame:
        f = _round(level, seed, last)
        if keys is not None:
            return df.groupBy(*keys).applyInPandas(f, _DECIDED)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rest = None  # the open units of the batches before go into the next batch
            for b in batches:
                done = f(b if rest is None else pd.concat([b, rest]))
                open_ = done["extra"] < 0
                rest = done[open_]
                yield done[~open_]
            if rest is not None and len(rest):
                yield rest

        return df.mapInPandas(run, _DECIDED)

    units = docs.join(F.broadcast(plan.select("source", "copies")), "source").where("copies > 0")  # one row per target
    # copies within 1e-9 of a whole number are whole: else 2.9999999999 copies would leave a fraction of every document
    near = F.abs(F.col("copies") - F.round("copies")) < 1e-9
    base = F.when(near, F.round("copies")).otherwise(F.floor("copies"))
    units = units.select("source", "doc_id", "n_tokens", base.cast("int").alias("base"), F.lit(0).alias("extra"), F.when(near, 0.0).otherwise(F.col("copies") - base).alias("p"), F.spark_partition_id().alias("part"))
    level = cut_lineage(rounded(units, 0, False, None))
    decided = [level.where("extra >= 0")]
    parts, depth = docs.rdd.getNumPartitions(), 1
    while True:
        last = parts <= fan_in
        up = level.where("extra < 0").withColumn("part", (F.col("part") / fan_in).cast("int")).withColumn("extra", F.lit(0))
        level = cut_lineage(rounded(up, depth, last, ["source", "part"]))
        decided.append(level.where("extra >= 0"))
        if last:
            break
        parts, depth = -(-parts // fan_in), depth + 1
    mixture = decided[0]
    for d in decided[1:]:
        mixture = mixture.unionByName(d)
    mixture = mixture.withColumn("copies", F.col("base") + F.col("extra")).where("copies > 0").select("source", "doc_id", "n_tokens", "copies")
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copies").alias("most_copies"))
    shares = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    shares = shares.select(
        "source", "weight", "max_repeats", F.col("share").alias("target_share"), "tokens", "docs", "mixed_tokens", "mixed_docs", "most_copies",
        F.coalesce(F.col("mixed_tokens") / F.sum("mixed_tokens").over(every), F.lit(0.0)).alias("actual_share"),
    )
    return mixture, shares
