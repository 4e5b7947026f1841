import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import neighbours, split
from quern.llm.additive import AdditiveQuantiser


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.é中#-\r", max_size=400), st.integers(4, 60), st.integers(0, 20))
def test_pieces_join_to_the_text_and_keep_the_limit(text, limit, overlap):
    cut = split.pieces(text, limit, overlap)
    assert "".join(text[own:e] for _, e, own in cut) == text
    for s, e, own in cut:
        assert s <= own <= e and len(text[s:e].encode()) <= limit
    for (_, e, _), (_, _, own) in zip(cut, cut[1:]):
        assert own == e


def test_pieces_cut_at_natural_boundaries():
    text = "First paragraph here.\n\nSecond one. It is longer.\n\nThird."
    assert [text[s:e] for s, e, _ in split.pieces(text, 30, 0)] == ["First paragraph here.\n\n", "Second one. It is longer.\n\n", "Third."]
    cut = split.pieces("one two three four five six seven", 16, 6)
    assert any(s < own for s, _, own in cut)


def test_split_texts(spark):
    df = spark.createDataFrame([(1, "x" * 100, 30, 5, 10, "n"), (2, "short", 30, 5, 0, "n"), (3, None, 30, 5, 1, "n"), (4, "", 30, 5, None, "n"), (5, "h1\nh2\n\nline one\nline two\r\nline three\n" * 2, 20, 4, 7, "n"), (2, "short", 30, 5, 0, "n")], "k int, text string, most int, lap int, line int, piece string")
    got = split.split_texts(df, "text", ["k"], "most", "lap", "line", 3).collect()
    by = {k: sorted((r for r in got if r.k == k), key=lambda r: r.piece_no) for k in range(1, 6)}
    assert len(by[1]) >= 4 and all(len(r.piece) <= 30 for r in by[1]) and by[1][0].n_pieces == len(by[1])
    assert [r.piece for r in by[2]] == ["short"] * 2 and by[2][0].line_from is None
    assert by[3] == [] and by[4][0].piece == ""
    assert by[5][0].line_from == 7 and by[5][-1].line_to >= 9
    assert split.split_texts(df.limit(0), "text", ["k"], "most", "lap").count() == 0


def brute(vecs, k, least):
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x @ x.T
    out = set()
    for i in range(len(ids)):
        near = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(c[i, j], 6), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in near if c[i, j] >= least}
    return out


def test_similar_vectors_with_copies_and_dirt(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    vecs = {i: base[i] for i in range(150)}
    for i in range(60):
        vecs[200 + i] = base[i] + rng.normal(size=16) * 0.05
    for i in range(40):
        vecs[400 + i] = base[7] * (i + 1)  # a group of copies, scaled
    rows = [("m", i, [float(x) for x in v]) for i, v in vecs.items()]
    rows += rows[:20] + [("m", 900, None), ("m", 901, [1.0]), ("m", 902, [0.0] * 16), ("m", 903, [float("nan")] * 16), ("m", 904, [float("inf")] * 16), ("x", 905, [1.0] * 16), ("m", 906, [None] * 16)]
    df = spark.createDataFrame(rows, "model_id string, id long, vec array<float>")
    specs = spark.createDataFrame([("m", 16), ("empty", 3)], "model_id string, dim int")
    got = {(r.id, r.other) for r in neighbours.similar_vectors(df, specs, k=5, min_cos=0.9, probes=8).collect()}
    want = brute(vecs, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.05 * len(want)
    asked = neighbours.similar_vectors(df, specs, k=5, probes=8, rerank=64, queries=__import__("pyspark").sql.functions.col("id") % 10 == 0).collect()
    truth = {p for p in brute(vecs, 5, -2) if p[0] % 10 == 0}
    assert len({(r.id, r.other) for r in asked} & truth) >= 0.9 * len(truth)
    assert neighbours.similar_vectors(df.limit(0), specs).count() == 0


def test_lookup_scores_equal_decoded_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = AdditiveQuantiser.fit(x, 4, books=4, entries=16)
    cell = q.cells_of(x)[:, 0]
    codes, norms, lost = q.encode(x, cell)
    one = int(cell[0])
    rows = np.flatnonzero(cell == one)
    decoded = q.centres[one] + sum(q.codebooks[m][codes[rows, m]] for m in range(4))
    assert np.allclose(norms[rows], np.linalg.norm(decoded, axis=1), atol=1e-4)
    assert np.allclose(lost[rows], np.linalg.norm(x[rows] - decoded, axis=1), atol=1e-4)
    assert np.allclose(q.scores(x[:5], one, codes[rows], norms[rows]), (x[:5] @ decoded.T) / norms[rows], atol=1e-4)
    narrow = AdditiveQuantiser(q.centres, q.codebooks, beam=1).encode(x, cell)
    loss = lambda c: ((x - q.centres[cell] - sum(q.codebooks[m][c[:, m]] for m in range(4))) ** 2).sum()
    assert loss(codes) <= loss(narrow[0])


def test_neighbours_in_a_hot_group_of_near_copies_are_the_true_ones(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1_200, 24))
    x[:800] = x[0] + rng.normal(size=(800, 24)) * 0.08  # differ, yet nearer to each other than cells and codes can tell
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    at = str(tmp_path / "points.parquet")
    pq.write_table(pa.table({"model_id": ["m"] * len(x), "id": np.arange(len(x)), "vec": pa.array(x.tolist(), pa.list_(pa.float32()))}), at)
    specs = spark.createDataFrame([("m", 24)], "model_id string, dim int")
    rows = neighbours.usable(spark.read.parquet(at), specs)
    fitted = neighbours.fit_quantisers(rows, cell_rows=100)
    assert len(fitted["m"].centres) == 12
    want = brute(dict(enumerate(x)), 5, 0.9)
    for coverage, least in ((1.0, 0.999), (0.97, 0.95)):
        near = neighbours.similar_vectors(spark.read.parquet(at), specs, 5, 0.9, coverage, 32, quantisers=fitted)
        got = {(r.id, r.other) for r in near.collect()}
        assert len(want) >= 4_000 and len(got & want) >= least * len(want)
    visits = neighbours.measure_visits(rows, fitted, 5, 0.97)["m"]
    assert 1 < visits < 12
