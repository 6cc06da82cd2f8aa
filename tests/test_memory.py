import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storygraph.operators import vector_blocks as V
from storygraph.operators.dbscan import dbscan
from storygraph.params import Params
from test_vectors import SCHEMA, brute_dbscan, labels


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_deciding_many_pairs_takes_little_memory():
    """65,536 doubtful pairs of wide vectors: their rows in double were 537 MB at once."""
    rows = np.random.default_rng(1).normal(size=(300, 512))
    i, j = np.random.default_rng(2).integers(0, 300, (2, 65536))
    out = {}
    assert peak_mb(lambda: out.update(dots=V.exact_dots(rows, rows, i, j))) < 100
    assert np.allclose(out["dots"], (rows @ rows.T)[i, j])


def test_a_block_is_held_in_float32_alone():
    from storygraph.operators.block_join import _sides

    raw = np.random.default_rng(3).normal(size=(8192, 512)).astype(np.float32)
    block = np.arange(8192) % 2
    pivots = np.arange(8192) % 7

    def batch(a, b):
        vec = pa.ListArray.from_arrays(np.arange(0, (b - a) * 512 + 1, 512, dtype=np.int32), raw[a:b].reshape(-1))
        columns = [pa.array(np.arange(a, b)), vec, pa.array(block[a:b]), pa.array(pivots[a:b]), pa.array(np.zeros(b - a, int)), pa.array(np.ones(b - a, int))]
        return pa.RecordBatch.from_arrays(columns, ["node", "vec", "_block", "_pivot", "_bi", "_bj"])

    table = pa.Table.from_batches([batch(0, 5000), batch(5000, 5001), batch(5001, 8192)])
    out = {}

    def work():
        left, right, same = _sides(table, True)
        list(V.similar_tiles(left.vectors, right.vectors, 0.99, same))
        out.update(left=left, right=right, same=same)

    # The block as it came and as unit rows are 34 MB; in double, with copies, it was more than 100.
    assert peak_mb(work) < 34 + 45
    left = out["left"]["node"].to_numpy()
    assert not out["same"] and (left % 2 == 0).all() and (np.diff(left % 7) >= 0).all() and len(left) + len(out["right"]) == 8192
    unit = raw[left].astype(np.float64)
    assert (out["left"].vectors.exact(slice(None)) == unit / np.linalg.norm(unit, axis=1, keepdims=True)).all()


@pytest.mark.parametrize("same", [True, False])
def test_rows_joined_already_are_not_compared_again(monkeypatch, same):
    monkeypatch.setattr(V, "TILE", 16)
    rng = np.random.default_rng(4)
    rows = np.concatenate([[5, 0, 0] + rng.normal(size=(150, 3)), rng.normal(size=(60, 3)), [[0, 0, 1.0]] * 3])
    rows = rng.permutation(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    a, b = (rows, rows) if same else (rows[:100], rows[100:])
    near = np.triu(rows @ rows.T >= 0.99, 1)
    if not same:
        near[:100, :100] = near[100:, 100:] = False
    whole, forest = V.Forest(len(rows)), V.Forest(len(rows))
    whole.add(*np.nonzero(near))
    shift, given = 0 if same else 100, 0
    for i, j in V.similar_tiles(a, b, 0.99, same, settled=forest.joined(shift)):
        given += len(i)
        forest.add(i, j + shift)
    assert (forest.root == whole.root).all()
    assert given < near.sum()
    # Rows left out of it meet all others.
    among, seen = rng.random(len(rows)) < 0.7, set()
    forest = V.Forest(len(rows))
    for i, j in V.similar_tiles(a, b, 0.99, same, settled=forest.joined(shift, among)):
        seen |= set(zip(i.tolist(), (j + shift).tolist(), strict=True))
        inner = among[i] & among[j + shift]
        forest.add(i[inner], j[inner] + shift)
    assert {(x, y) for x, y in zip(*np.nonzero(near), strict=True) if not (among[x] and among[y])} <= seen


@pytest.mark.parametrize("min_samples, blocks", [(2, 1), (3, 1), (5, 2)])
def test_dense_rows_over_several_tiles_with_strays(spark, min_samples, blocks):
    rng = np.random.default_rng(5)
    dense = np.ones((4000, 8)) + rng.normal(scale=0.2, size=(4000, 8))
    data = rng.permutation(np.concatenate([dense, rng.normal(size=(700, 8))])).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA)
    got = labels(dbscan(df, "id", "vec", 0.05, min_samples, blocks=blocks))
    assert got == brute_dbscan(data.astype(np.float64), 0.05, min_samples)


def test_pages_are_parsed_in_pieces():
    from storygraph.operators.extract import in_pieces

    html = ["x" * n for n in (3, 50, 1, 1, 0, 200, 7)]
    batch = pa.RecordBatch.from_pydict({"url": [str(k) for k in range(7)], "html": html})
    pieces = list(in_pieces(batch, 20))
    assert [p.column("html").to_pylist() for p in pieces] == [html[:1], html[1:5], html[5:6], html[6:]]
    assert len(list(in_pieces(batch))) == 1 and not list(in_pieces(batch.slice(0, 0)))


def test_grams_of_many_texts_are_hashed_together(monkeypatch):
    from storygraph.operators import embed

    def plain(text, dim):
        out = np.zeros(dim, np.int64)
        for passage in text.lower().split("\n\n"):
            words = passage.encode().split()
            for gram in words if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:])):
                h = int(hashlib.md5(gram).hexdigest()[:8], 16)
                out[h % dim] += 1 - 2 * (h // dim % 2)
        return out

    texts = ["", "A", "a  b\n\nc", " \n\n\n", "x" * 53 + " y", "x" * 54 + " y", "é" * 30 + " B c Ä\x0b\x0cq\x1cr \x85 s", "a b c d e f\n\n g h", "z " * 500]
    for most in (1 << 20, 3):
        monkeypatch.setattr(embed, "GROUP_CHARS", most)
        monkeypatch.setattr(embed, "GRAMS", 7 if most == 3 else 16384)
        got = list(embed.counts_of(texts, 32))
        assert len(got) == len(texts) and all((g == plain(t, 32)).all() for g, t in zip(got, texts, strict=True))
    # One call of the digest for each gram was most of the time of an embedding.
    calls = []
    monkeypatch.setattr(embed.hashlib, "md5", lambda b: calls.append(b))
    embed.ngram_counts("some words that are short enough " * 50, 64)
    assert not calls


@pytest.mark.parametrize("same", [True, False])
def test_neighbouring_runs_are_met_in_one_tile(same):
    rng = np.random.default_rng(6)
    left = np.sort(rng.integers(0, 60, 5000))
    right = left if same else np.sort(rng.integers(0, 60, 3000))
    apart = np.abs(np.arange(60)[:, None] - np.arange(60))
    for reach in (apart >= 0, apart <= 3):
        met = np.zeros((len(left), len(right)), bool)
        tiles = list(V.Segments(len(left), len(right), left, right, reach).pairs(same))
        for a, b, c, d in tiles:
            assert b - a <= V.TILE and d - c <= V.TILE and (not same or (a, b) == (c, d) or b <= c)
            assert not met[a:b, c:d].any()
            met[a:b, c:d] = True
        wanted = reach[np.ix_(left, right)]
        assert (met | ~(np.triu(wanted) if same else wanted)).all()
        # One tile for each pair of pivots were 1,830 and more.
        assert len(tiles) <= (20 if apart[reach].max() > 3 else 140)


def test_products_of_heads_decide_most_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 128)).astype(np.float32)
    rows = np.concatenate([base, base[:200] + rng.normal(scale=0.2, size=(200, 128)).astype(np.float32), base[:50]])
    rows = rows[rng.permutation(len(rows))]
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    a, b = V.Vectors(rows, np.linalg.norm(rows.astype(np.float64), axis=1)), V.Vectors(unit)
    monkeypatch.setattr(V, "TILE", 256)
    whole, plain = [], V.at_least
    monkeypatch.setattr(V, "at_least", lambda sims, bar: (whole.append(sims.shape), plain(sims, bar))[1])
    undecided, pairs = [], V.Bounded.pairs
    monkeypatch.setattr(V.Bounded, "pairs", lambda *x: (found := pairs(*x), undecided.append(found is None))[0])
    near = np.triu(unit @ unit.T >= 0.8, 1)
    got = {(x, y) for i, j in V.similar_tiles(a, a, 0.8, True) for x, y in zip(i.tolist(), j.tolist())}
    assert got == set(zip(*(k.tolist() for k in np.nonzero(near)))) and len(got) >= 200
    assert np.mean(undecided) < 0.2
    # The nearest of all: the first of equal ones, wherever rows begin.
    for left, right in ((a, b), (b, a)):
        sims = unit @ unit[::-1].T
        flipped = V.Vectors(right.raw[::-1].copy(), None if right.norms is None else right.norms[::-1].copy())
        arg, best = V.best_match(left, flipped)
        assert np.allclose(best, sims.max(axis=1)) and (sims[np.arange(len(arg)), arg] >= sims.max(axis=1) - 1e-12).all()
        floor = np.where(np.arange(len(arg)) % 2, best, best + 0.01)
        again, best_again = V.best_match(left, flipped, floor)
        assert (again == np.where(np.arange(len(arg)) % 2, arg, -1)).all() and (best_again[1::2] == best[1::2]).all()


def test_counts_of_a_cluster_are_added_before_they_are_dealt(spark):
    from storygraph.operators import clusters as C
    from storygraph.operators.embed import ngram_counts

    texts = ["a b c d", "b c d e", "", None, "x y", "c d e f g", "a b c d", "  ", "q"]
    rows = [(None if k % 5 == 4 else f"c{k % 5}", k % 2, texts[k % 9]) for k in range(400)] + [("empty", 0, ""), ("null", 1, None)]
    df = spark.createDataFrame(rows, "cluster_id string, form int, passage string").repartition(3)
    wanted = {}
    for key, form, text in rows:
        if text is not None and (found := ngram_counts(text, 16)).any():
            wanted.setdefault(key, np.zeros(32, np.int64))[16 * form : 16 * form + 16] += found
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", "4096"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            sums = C.sum_counts(df, ["cluster_id"], "passage", 16, 2)
            got = sums.collect()
            assert len(got) == len(wanted) and {r.cluster_id: r.sums for r in got} == {k: v.tolist() for k, v in wanted.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    # A row for each bucket of each member was dealt out.
    assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()


def test_parts_of_the_articles_meet_clusters_in_waves(spark, monkeypatch):
    from storygraph.operators import nearest as N

    monkeypatch.setattr(N, "WAVE", 2)
    rng = np.random.default_rng(9)
    vec = rng.normal(size=(400, 64))
    # Copies of cluster vectors, and clusters that are equally near.
    left = np.concatenate([vec[:100], rng.normal(size=(100, 64))]).astype(np.float32)
    right = np.concatenate([vec, vec[:40]]).astype(np.float32)
    articles = spark.createDataFrame([(f"a{k}", v.tolist()) for k, v in enumerate(left)], "id string, v array<float>")
    clusters = spark.createDataFrame([(f"c{k}", v.tolist(), 1000 - k) for k, v in enumerate(right)], "cluster_id string, cluster_embedding array<float>, last_updated bigint")
    made, plain = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df: (made.append(1), plain(df))[1])
    found = [sorted(map(tuple, N.nearest_join(articles, clusters, "id", "v", Params(block_rows=40), mode).collect())) for mode in ("broadcast", "blocks")]
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]] and np.allclose([r[2] for r in found[0]], [r[2] for r in found[1]])
    assert {r[0]: r[1] for r in found[1]}["a3"] == "c403"
    # Five parts are three waves of two tables each; all parts' copies of the clusters were on disk at once.
    assert len(made) == 2 + 3 * 2
