"""Exact nearest vectors, rank fusion and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision; null where the lengths differ."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(id, dist): the k nearest vectors to a query, ties by id; ``allowed`` (id) filters before, an empty one gives nothing.

    Vectors of another length and negative ids are no candidates. One narrow pass and a top-k.
    """
    rows = vectors.where((F.col("id") >= 0) & (F.size("vec") == len(query)))
    if allowed is not None:
        rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", squared_distance(F.col("vec"), q).alias("dist")).orderBy("dist", "id").limit(k)


def fuse(left: DataFrame, right: DataFrame, limit: int, k: int = 60, left_name: str = "fts5", right_name: str = "vector") -> DataFrame:
    """(symbol_id, score, provenance): reciprocal-rank fusion of two ranked lists (symbol_id, position from 0).

    Negative ids are skipped; the best ``limit`` stay, 20 if it is not positive; ties by symbol_id.
    """
    side = lambda df, name: df.where("symbol_id >= 0").select("symbol_id", (F.lit(1.0) / (F.lit(k) + F.col("position") + 1)).alias("s"), F.lit(name).alias("leg"))
    both = side(left, left_name).unionByName(side(right, right_name)).groupBy("symbol_id").agg(F.sum("s").alias("score"), F.countDistinct("leg").alias("legs"), F.min("leg").alias("leg"))
    return both.select("symbol_id", "score", F.when(F.col("legs") == 2, "both").otherwise(F.col("leg")).alias("provenance")).orderBy(F.desc("score"), "symbol_id").limit(limit if limit > 0 else 20)


def positions(df: DataFrame, order: list) -> DataFrame:
    """A short ranked list with its positions from 0."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)


def candidates(limit: int, configured: int = 100) -> int:
    """How many rows of each leg are fused."""
    return configured if configured > 0 else max(limit * 3, 60)


def mean_pool(tokens: DataFrame, key: str) -> DataFrame:
    """(key, vec): unit mean of the unmasked vectors of each key; a zero vector if all are masked. tokens: (key, mask, vec).

    Each task first adds up its own vectors per key, so a key costs one vector a task however many it has.
    """
    kind = tokens.schema[key].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for k, mask, vec in zip(b[key].tolist(), b["mask"].tolist(), b["vec"].tolist()):
                if vec is None:
                    continue
                at = sums.setdefault((k, len(vec)), [0, np.zeros(len(vec))])
                if mask and mask > 0:
                    at[0] += 1
                    at[1] += np.asarray(vec, float)
        yield pd.DataFrame({key: [k for k, _ in sums], "size": [d for _, d in sums], "n": [n for n, _ in sums.values()], "total": [v.tolist() for _, v in sums.values()]})

    parts = tokens.where(F.col(key).isNotNull()).select(key, "mask", "vec").mapInPandas(add, f"{key} {kind}, size int, n bigint, total array<double>")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        total, n = np.sum(np.stack(g["total"].tolist()), axis=0), int(g["n"].sum())
        mean = total / n if n else total
        norm = float(np.sqrt((mean**2).sum()))
        return pd.DataFrame({key: g[key].iloc[:1], "vec": [(mean / norm if norm >= 1e-12 else mean).tolist()]})

    return parts.groupBy(key, "size").applyInPandas(merge, f"{key} {kind}, vec array<double>")


@dataclass
class VectorStore:
    """Vectors of one length by id, kept as a table."""

    vectors: DataFrame  # id long, vec array<float>
    dim: int

    def _checked(self, rows: DataFrame) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit(f"a vector of {self.dim} entries is wanted, not of "), F.size("vec").cast("string")))
        return rows.select("id", F.when(F.size("vec") == self.dim, F.col("vec")).otherwise(wrong.cast("array<float>")).alias("vec"))

    def upsert(self, rows: DataFrame) -> VectorStore:
        """With the vectors of rows (id, vec) in place of those of their ids; another length raises an error."""
        return VectorStore(self.remove(rows).vectors.unionByName(self._checked(rows)), self.dim)

    def remove(self, ids: DataFrame) -> VectorStore:
        """Without the given ids (id)."""
        return VectorStore(self.vectors.join(ids.select("id").distinct(), "id", "left_anti").select("id", "vec"), self.dim)

    def search(self, query: Sequence[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(id, dist) of the nearest vectors; a query of another length raises an error."""
        if len(query) != self.dim:
            raise ValueError(f"a query of {self.dim} entries is wanted, not of {len(query)}")
        return nearest(self.vectors, query, k, allowed)

    def save(self, folder: str) -> None:
        """Writes the vectors to a folder."""
        self.vectors.withColumn("dim", F.lit(self.dim)).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, dim: int) -> VectorStore:
        """The store of a folder; one of other columns raises an error."""
        rows = spark.read.parquet(folder)
        if not {"id", "vec"} <= set(rows.columns):
            raise ValueError(f"{folder} holds no vectors")
        return cls(rows.select("id", "vec"), dim)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], prefix: str = "", most: int = 2_048) -> DataFrame:
    """(id, vec): vectors of texts (id, text) by a function over lists of texts, in Arrow batches; null texts give no row.

    prefix: what precedes each text, as models want it for queries. most: characters a text is cut to before the
    model's own limit of tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": embed([prefix + t[:most] for t in b["text"]]) if len(b) else []})

    return texts.where("text IS NOT NULL").select("id", "text").mapInPandas(run, "id bigint, vec array<float>")
