"""The most similar vectors of every vector (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.additive import AdditiveQuantiser
from quern.operators.skew import salt_of
from quern.plans.tables import cut_lineage

#: Rows per model the codebooks are fitted on: at least so many, more where there are many cells, at most so many (a bounded sample; every row is indexed).
SAMPLE, MOST_SAMPLE = 8_192, 262_144
#: Wanted rows in a cell, and vectors of a model with which the number of visited cells is measured.
CELL_ROWS, MEASURED = 4_000, 256
#: Rows of the index and of the queries one task scores at a time.
INDEX_BLOCK, QUERY_BLOCK = 8_192, 65_536
SALTS = 16
#: Standard deviations of the estimated cosines within which a row that was not scored exactly may still be an answer.
DEVIATIONS = 4.0
#: Rows of a block from which all of them are scored for a query.
WHOLE = 512


def _unit(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are finite and not all zero, their unit vectors, fingerprints that vectors share which agree to five decimals)."""
    x = flat.reshape(-1, dim)
    top = np.abs(x).max(axis=1)
    ok = np.flatnonzero(np.isfinite(top) & (top > 0))
    x = x[ok] / top[ok, None]
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    whole = (np.round(x * 1e5) + 0.0).astype(np.int64).astype(np.uint64)
    odd = np.random.default_rng(17).integers(0, 1 << 63, (2, dim), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    prints = np.stack([(whole * o).sum(axis=1, dtype=np.uint64) for o in odd], axis=1)
    return ok, x, prints


def _by_model(b: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, dim, ids, unit vectors, fingerprints) of a batch of (model_id, id, vec) whose vectors have the length of their model."""
    vecs, models = b.column(2), np.asarray(b.column(0).to_pylist(), object)
    ids = b.column(1).to_numpy(zero_copy_only=False)
    flat = np.asarray(vecs.values.to_numpy(zero_copy_only=False), np.float64)
    starts = vecs.offsets.to_numpy()
    for model in dict.fromkeys(models):
        at = np.flatnonzero(models == model)
        dim = int(starts[at[0] + 1] - starts[at[0]])
        ok, x, prints = _unit(flat[(starts[at][:, None] + np.arange(dim)).ravel()], dim)
        if len(ok):
            yield model, dim, ids[at[ok]], x, prints


def usable(vectors: DataFrame, specs: DataFrame) -> DataFrame:
    """(model_id, id, vec): vectors of a known model with as many entries as it has. specs has a row per model; its size is the number of models."""
    return vectors.join(F.broadcast(specs), "model_id").where("id IS NOT NULL").where(F.size("vec") == F.col("dim")).select("model_id", "id", "vec")


def _matrix(packed: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f4").reshape(len(packed), -1)


def fit_quantisers(rows: DataFrame, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> dict[str, AdditiveQuantiser]:
    """One quantiser per model, fitted in the driver on a bounded sample of its vectors, chosen by a hash of the id.

    The sample has about four vectors for each cell wanted, at least ``sample`` and at most MOST_SAMPLE. ``sizes`` of
    the result estimates the different vectors of each cell.
    """
    counts = {r["model_id"]: r["count"] for r in rows.groupBy("model_id").count().collect()}  # one row per model
    share = F.lit(0.0)
    for model, n in counts.items():
        share = F.when(F.col("model_id") == model, min(1.0, min(MOST_SAMPLE, max(sample, 4 * n // cell_rows)) / n)).otherwise(share)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, _, ids, x, prints in _by_model(b) if len(b) else ():
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())], ["model_id", "id", "same", "vec"])

    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).mapInArrow(clean, "model_id string, id bigint, same binary, vec binary").toPandas()
    made = {}
    for model, g in chosen.groupby("model_id"):
        one = g.sort_values("id").drop_duplicates("same")
        x = _matrix(one["vec"].tolist())
        n = counts[model] * len(x) // max(1, g["id"].nunique())
        q = AdditiveQuantiser.fit(x, int(np.clip(n // cell_rows, 1, max(1, len(x) // 4))))
        q.sizes = np.bincount(q.cells_of(x)[:, 0], minlength=len(q.centres)) * (n / len(x))
        q.measured = x[np.linspace(0, len(x) - 1, min(MEASURED, len(x))).astype(int)]
        made[model] = q
    return made


def measure_visits(rows: DataFrame, quantisers: dict[str, AdditiveQuantiser], k: int, coverage: float) -> dict[str, int]:
    """Per model, the cells a query must visit so that at least ``coverage`` of the true k most similar vectors lie in them.

    MEASURED vectors of each model are compared with every row, exactly, in the batches of one pass; each task keeps the
    k best of each and how many cells are nearer than theirs.
    """
    shared = rows.sparkSession.sparkContext.broadcast(quantisers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}
        for b in batches:
            for model, _, _, x, prints in _by_model(b) if len(b) else ():
                q = shared.value[model]
                x = x.astype(np.float32)
                cos = q.measured @ x.T
                held = best.setdefault(model, [[] for _ in q.measured])
                take = min(k + 1, len(x))
                top = np.argpartition(-cos, take - 1, axis=1)[:, :take]
                for i in range(len(q.measured)):
                    held[i] += [(float(cos[i, j]), prints[j].tobytes(), x[j]) for j in top[i]]
                    if len(held[i]) > 8 * k:
                        held[i] = _first(held[i], k)
        for model, held in best.items():
            q = shared.value[model]
            rank = np.argsort(np.argsort(-(q.measured @ q.centres.T - 0.5 * (q.centres**2).sum(1)), axis=1), axis=1)
            out = [(i, c, p, int(rank[i, q.cells_of(v[None])[0, 0]])) for i, h in enumerate(held) for c, p, v in _first(h, k)]
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(out)), *(pa.array(list(col), t) for col, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.binary(), pa.int32())))], ["model_id", "query", "cos", "same", "rank"])

    found = rows.mapInArrow(run, "model_id string, query int, cos double, same binary, rank int")
    found = found.groupBy("model_id", "query", "same").agg(F.max("cos").alias("cos"), F.first("rank").alias("rank"))
    order = Window.partitionBy("model_id", "query").orderBy(F.desc("cos"), "same")
    ranks = found.where("cos < 0.9999999").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("model_id", "rank").count().collect()  # at most MEASURED * k rows per model
    visits = {}
    for model in quantisers:
        mine = sorted((r["rank"], r["count"]) for r in ranks if r["model_id"] == model)
        total, seen, visits[model] = sum(n for _, n in mine), 0, 1
        for rank, n in mine:
            if seen >= coverage * total:
                break
            seen += n
            visits[model] = rank + 1
    return visits


def _first(held: list, k: int) -> list:
    """The k best different ones but for the vector itself."""
    out, seen = [], set()
    for h in sorted(held, key=lambda h: (-h[0], h[1])):
        if h[1] not in seen:
            seen.add(h[1])
            out.append(h)
    return out[: k + 1]


def similar_vectors(
    vectors: DataFrame, specs: DataFrame, k: int = 5, min_cos: float = -2.0, coverage: float = 0.97, rerank: int = 48, queries: Column | None = None, quantisers: dict[str, AdditiveQuantiser] | None = None, probes: int | None = None
) -> DataFrame:
    """(model_id, id, other, cos): the k most similar vectors of each vector of its model, ties by the smaller id.

    vectors: (model_id, id, vec); specs: (model_id, dim). queries: a condition on id that chooses the vectors
    asked for (all by default); the index always holds every vector.

    Every vector is encoded by beam search over additive codebooks and indexed in the cell of its nearest centre. A
    query visits its nearest cells, as many as hold ``coverage`` of the true neighbours of some measured vectors, at
    any size of the table (``probes`` sets their number instead). Within a cell lookup tables score the codes and the best ``rerank`` are scored exactly, in
    full precision. Where more rows than those may be better than the worst answer, by DEVIATIONS of what the codes
    leave out, the query is scored exactly against the whole block. Index and queries of a cell meet in blocks
    of bounded size, so no task ever holds a whole hot cell; only vectors of the blocks are shuffled, once.

    Vectors that agree are searched once: in each input task the first of them stands for the others, one of these for
    the whole group, and the answers are then widened by the smallest ids of each group, which is all that ties at
    the top can bring. A group of any size thus costs k + 1 rows. Null, odd-sized, non-finite and all-zero vectors
    and null ids take no part; empty tables give no rows; repeated rows count once; extra columns are not read.
    """
    vectors, specs = vectors.select("model_id", "id", "vec"), specs.select("model_id", "dim")
    rows = usable(vectors, specs)
    quantisers = fit_quantisers(rows) if quantisers is None else quantisers
    visits = measure_visits(rows, quantisers, k, coverage) if probes is None else dict.fromkeys(quantisers, probes)
    # centres and codebooks: at most MOST_SAMPLE / 4 + 1,024 vectors a model
    shared = rows.sparkSession.sparkContext.broadcast((quantisers, visits))
    asked = rows.withColumn("wanted", F.lit(True) if queries is None else queries)
    share = 1.0 if queries is None else asked.where("wanted").count() / max(1, asked.count())

    # groups of vectors that agree: those with more than one id, the smallest of which stands for them
    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, _, ids, _, prints in _by_model(b) if len(b) else ():
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())], ["model_id", "id", "same"])

    members = rows.mapInArrow(prints_of, "model_id string, id bigint, same binary")
    groups = cut_lineage(members.groupBy("model_id", "same").agg(F.min("id").alias("rep"), F.max("id").alias("_last")).where("rep < _last").select("model_id", "same", "rep"))
    some = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = cut_lineage(members.withColumn("_salt", salt_of(SALTS, "id")).join(some, ["model_id", "same", "_salt"]).select("model_id", "same", "rep", "id").distinct())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the blocks that index it and to those of the cells it visits as a query."""
        quantisers, visits = shared.value
        seen: dict[tuple, int] = {}
        done: set[tuple] = set()
        for b in batches:
            wanted = dict(zip(b.column(1).to_pylist(), b.column(3).to_pylist()))
            for model, _, ids, x, prints in _by_model(b) if len(b) else ():
                q = quantisers[model]
                x = x.astype("<f4")
                role = np.zeros(len(ids), int)
                for i, (p, mine) in enumerate(zip([p.tobytes() for p in prints], ids.tolist())):
                    if seen.get((model, p), mine + 1) > mine:
                        seen[model, p] = mine
                        role[i] = 1
                    if wanted[mine] and (model, p) not in done:
                        done.add((model, p))
                        role[i] |= 2
                at = np.flatnonzero(role)
                if not len(at):
                    continue
                x, prints, ids, role = x[at], prints[at], ids[at], role[at]
                cells = q.cells_of(x, visits.get(model, 1))
                codes, norms, lost = q.encode(x, cells[:, 0])
                n_index = np.maximum(1, np.ceil(q.sizes / INDEX_BLOCK)).astype(int)
                n_query = np.maximum(1, np.ceil(q.sizes * cells.shape[1] * share / QUERY_BLOCK)).astype(int)
                out: list[tuple] = []
                for i, mine in enumerate(ids.tolist()):
                    c0, places = int(cells[i, 0]), {}
                    if role[i] & 1:
                        here = int(prints[i, 0] % np.uint64(n_index[c0]))
                        places = {(c0, here, j): 1 for j in range(n_query[c0])}
                    if role[i] & 2:
                        for c in cells[i].tolist():
                            j = int(prints[i, 1] % np.uint64(n_query[c]))
                            for ib in range(n_index[c]):
                                places[c, ib, j] = places.get((c, ib, j), 0) | 2
                    p, vec, code, norm, left = prints[i].tobytes(), x[i].tobytes(), codes[i].tobytes(), float(norms[i]), float(lost[i])
                    for (c, ib, j), r in places.items():
                        out.append((model, c, ib, j, r, mine, p, vec, code, norm, left) if r & 1 else (model, c, ib, j, r, mine, p, vec, None, None, None))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float32(), pa.float32())
                yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*out), kinds)], ["model_id", "cell", "ib", "qb", "role", "id", "same", "vec", "codes", "norm", "lost"])

    def score(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        model, cell = key[0], int(key[1])
        q = shared.value[0][model]
        held = g[g["role"].to_numpy() & 1 > 0].sort_values("id").drop_duplicates("same")
        want = g[g["role"].to_numpy() & 2 > 0].drop_duplicates("id")
        nothing = pd.DataFrame({"model_id": np.array([], object), "id": np.array([], np.int64), "same": np.array([], object), "other": np.array([], np.int64), "cos": np.array([], np.float64)})
        if held.empty or want.empty:
            return nothing
        ids, x, prints = held["id"].to_numpy(), _matrix(held["vec"].tolist()), held["same"].to_numpy()
        codes = np.ascontiguousarray(np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1).T.astype(np.intp))
        norms = held["norm"].to_numpy(np.float32)
        # the product of a vector with its approximation scales the estimate; what the codes leave out scatters it
        scale = np.maximum((1.0 + norms**2 - held["lost"].to_numpy(np.float32) ** 2) / 2.0, 1e-3).astype(np.float32)
        scatter = (DEVIATIONS * np.sqrt(np.maximum((norms / scale) ** 2 - 1.0, 0.0)) / np.sqrt(x.shape[1])).astype(np.float32)
        number = {p: i for i, p in enumerate(prints)}
        got = []
        take = min(rerank, len(ids))
        for at in range(0, len(want), 256):
            part = want.iloc[at : at + 256]
            mine, y = part["id"].to_numpy(), _matrix(part["vec"].tolist())
            own = np.array([number.get(p, -1) for p in part["same"]])
            have = np.flatnonzero(own >= 0)
            products = q.products(y, cell, codes)
            products[own[have], have] = -np.inf
            if min_cos > 0.0:
                # whatever may reach the least cosine is scored exactly, pair by pair, or row by row where there is much of it
                fits = products >= ((min_cos - scatter * np.sqrt(1.0 - min_cos**2)) * scale)[:, None]
                many = np.flatnonzero(fits.sum(axis=0) > WHOLE)
                fits[:, many] = False
                other, which = np.nonzero(fits)
                cos = np.einsum("pd,pd->p", y[which], x[other])
                if len(many):
                    full = y[many] @ x.T
                    full[own[many][:, None] == np.arange(len(ids))[None, :]] = -np.inf
                    r, c = np.nonzero(full >= min_cos - 1e-6)
                    which, other, cos = np.concatenate([which, many[r]]), np.concatenate([other, c]), np.concatenate([cos, full[r, c]])
                fine = cos >= min_cos - 1e-6
                which, other, cos = which[fine], other[fine], cos[fine]
            else:
                s = np.ascontiguousarray((products / scale[:, None]).T)
                top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(take), (len(mine), 1))
                exact = np.einsum("qd,qrd->qr", y, x[top])
                exact[own[:, None] == top] = -np.inf
                worst = np.clip(-np.partition(-exact, min(k, take) - 1, axis=1)[:, min(k, take) - 1], -1.0, 1.0)[:, None]
                s += scatter * np.sqrt(1.0 - worst**2)
                open_ = np.flatnonzero((s >= worst).sum(axis=1) > take) if take < len(ids) else np.array([], int)
                if len(open_):
                    full = y[open_] @ x.T
                    full[own[open_][:, None] == np.arange(len(ids))[None, :]] = -np.inf
                    top[open_] = np.argpartition(-full, take - 1, axis=1)[:, :take]
                    exact[open_] = np.take_along_axis(full, top[open_], 1)
                which, other, cos = np.repeat(np.arange(len(mine)), take), top.ravel(), exact.ravel()
                fine = cos >= max(min_cos - 1e-6, -1.5)
                which, other, cos = which[fine], other[fine], cos[fine]
            if not len(which):
                continue
            order = np.lexsort((ids[other], -cos, which))
            which, other = which[order], other[order]
            first = np.r_[0, np.flatnonzero(np.diff(which)) + 1]
            place = np.arange(len(which)) - np.repeat(first, np.diff(np.r_[first, len(which)]))
            which, other = which[place < k], other[place < k]
            value = np.einsum("qd,qd->q", y[which].astype(np.float64), x[other].astype(np.float64))
            got.append(pd.DataFrame({"model_id": model, "id": mine[which], "same": part["same"].to_numpy()[which], "other": ids[other], "cos": value}))
        return pd.concat(got) if got else nothing

    schema = "model_id string, cell int, ib int, qb int, role byte, id bigint, same binary, vec binary, codes binary, norm float, lost float"
    routed = asked.select("model_id", "id", "vec", "wanted").mapInArrow(route, schema)
    here = ["model_id", "cell", "ib", "qb"]
    near = routed.groupBy(*here).applyInPandas(score, "model_id string, id bigint, same binary, other bigint, cos double").where(F.col("cos") >= min_cos)
    heads = _heads(copies, ["model_id", "same"], [F.col("id")], k + 1)
    # answers to and of whichever vector of a group was searched are put under the name of the one that stands for it
    best = Window.partitionBy("model_id", "id").orderBy(F.desc("cos"), "other")
    name = copies.where("id <> rep").select("model_id", F.col("id").alias("_id"), F.col("rep").alias("_rep"))
    for side in ("id", "other"):
        near = near.withColumnRenamed(side, "_id").join(name, ["model_id", "_id"], "left").withColumn(side, F.coalesce("_rep", "_id")).drop("_id", "_rep")
    near = near.where("id <> other").groupBy("model_id", "id", "other").agg(F.max("cos").alias("cos"))
    near = cut_lineage(near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"))
    # each answer widened by the ids that agree with it
    wide = near.join(heads.select("model_id", F.col("rep").alias("other"), F.col("id").alias("_member")), ["model_id", "other"], "left").withColumn("other", F.coalesce("_member", "other")).drop("_member")
    own = heads.select("model_id", F.col("rep").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("cos"))
    answers = wide.unionByName(own)  # at most k + 1 heads and k * (k + 1) neighbours for a group
    single = answers.join(groups.select("model_id", F.col("rep").alias("id")), ["model_id", "id"], "left_anti")
    if queries is not None:
        copies = copies.where(queries)
        single = single.where(queries)
    shared_answers = answers.withColumnRenamed("id", "rep").join(groups.select("model_id", "rep"), ["model_id", "rep"], "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grouped = copies.withColumn("_salt", salt_of(SALTS, "id")).join(shared_answers, ["model_id", "rep", "_salt"]).select("model_id", "id", "other", "cos")
    pairs = single.unionByName(grouped).where("id <> other")
    return pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).where(F.col("cos") >= min_cos).select("model_id", "id", "other", "cos")


def _heads(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, in two steps so that a hot key is first cut down in many tasks."""
    salted = rows.withColumn("_salt", salt_of(SALTS, "id"))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
