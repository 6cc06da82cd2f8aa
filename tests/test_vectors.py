import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storygraph.operators.components import connected_components
from storygraph.operators.dbscan import dbscan, eps_join
from storygraph.operators.nearest import assign_to_clusters
from storygraph.operators.vector_blocks import best_match, similar_tiles
from storygraph.params import Params

SCHEMA = "id bigint, vec array<float>"


def plane(spark, degrees):
    rows = [(i, [math.cos(math.radians(d)), math.sin(math.radians(d))]) for i, d in enumerate(degrees)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(df):
    return {r.id: r.label for r in df.collect()}


def brute_dbscan(vectors, eps, min_samples):
    """Textbook DBSCAN on a full distance matrix; label = smallest core of the cluster."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 1 - eps
    core = near.sum(axis=1) >= min_samples
    label = [None] * len(unit)
    for i in range(len(unit)):
        if not core[i] or label[i] is not None:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if label[x] is None:
                label[x] = i
                if core[x]:
                    todo.extend(np.flatnonzero(near[x]))
    return dict(enumerate(label))


@pytest.mark.parametrize("min_samples,expected", [(2, [0, 0, 0, None]), (3, [1, 1, 1, None]), (4, [None] * 4)])
def test_chain_of_neighbours(spark, min_samples, expected):
    got = labels(dbscan(plane(spark, [0, 30, 60, 180]), "id", "vec", 0.2, min_samples))
    assert [got[i] for i in range(4)] == expected


@pytest.mark.parametrize("min_samples,blocks", [(1, 2), (2, 1), (2, 4), (3, 1), (3, 3), (5, 2)])
def test_matches_brute_force_with_copies(spark, min_samples, blocks):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    data = np.repeat(centres, 8, axis=0) + rng.normal(scale=0.35, size=(96, 6))
    data = np.concatenate([data, np.repeat(data[:3], 10, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA)
    got = labels(dbscan(df, "id", "vec", 0.05, min_samples, blocks=blocks))
    assert got == brute_dbscan(data.astype(np.float64), 0.05, min_samples)


def test_vectors_without_direction_are_noise(spark):
    rows = [(0, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0])]
    got = labels(dbscan(spark.createDataFrame(rows, SCHEMA), "id", "vec", 0.2, 2))
    assert got == {0: None, 1: None, 2: None, 3: 3, 4: 3}


def test_pairs_do_not_depend_on_blocks(spark):
    df = plane(spark, [0, 10, 20, 90, 95, 180, 10])
    results = [
        sorted((r.left_id, r.right_id, r.left_copies, r.right_copies) for r in eps_join(df, "id", "vec", 0.02, blocks=b).collect())
        for b in (1, 2, 5)
    ]
    assert results[0] == results[1] == results[2] == [(0, 1, 1, 2), (1, 2, 2, 1), (3, 4, 1, 1)]


def test_dense_group_gives_a_forest_not_all_pairs(spark):
    """A third of the rows within eps of each other: at most one edge per row leaves a task."""
    from storygraph.operators.block_join import make_blocks, self_grid
    from storygraph.operators.dbscan import _forest_kernel

    rng = np.random.default_rng(1)
    data = np.concatenate([np.ones((300, 8)) + rng.normal(scale=0.01, size=(300, 8)), rng.normal(size=(600, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "node bigint, vec array<float>")
    edges = self_grid(make_blocks(df, "node", 900, 300, 1000, 0.6, blocks=3), _forest_kernel(0.8), "src bigint, dst bigint")
    assert edges.count() <= 3 * 900
    assert connected_components(edges).filter("node < 300").select("component").distinct().count() == 1


def test_no_cross_join_in_plans(spark):
    for plan in (eps_join(plane(spark, [0, 1]), "id", "vec", 0.2), dbscan(plane(spark, [0, 1]), "id", "vec", 0.2, 2)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100 + i, 1000) for i in range(50)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "src bigint, dst bigint").orderBy(F.rand(3))
    for last in (1000, 0):  # finished by one pass over the forests, and by steps alone
        got = {r.node: r.component for r in connected_components(edges, last=last).collect()}
        assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 150), 1000]}
        assert connected_components(edges.filter("false"), last=last).isEmpty()


def test_components_of_random_edges_in_small_chunks(spark, monkeypatch):
    from storygraph.operators import components

    monkeypatch.setattr(components.contracted, "__defaults__", (7,))
    draw = np.random.default_rng(2)
    pairs = [(f"n{a:03d}", f"n{b:03d}") for a, b in draw.integers(0, 400, size=(330, 2)).tolist()]
    root = {n: n for p in pairs for n in p if p[0] != p[1]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(5)
    assert {r.node: r.component for r in connected_components(edges, last=0).collect()} == {n: find(n) for n in root}


def clustered(n_centres, each, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_centres, width))
    data = np.repeat(centres, each, axis=0) + rng.normal(scale=spread, size=(n_centres * each, width))
    return data.astype(np.float32)


def vectors(spark, data, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(data)], SCHEMA)


INDEXED = Params(index_rows=0, block_rows=64)


@pytest.mark.parametrize("min_samples", [2, 4])
def test_metric_index_gives_the_labels_of_brute_force(spark, min_samples):
    data = np.concatenate([clustered(20, 12, 8, 3, 0.25), clustered(1, 150, 8, 4, 0.01)])
    got = labels(dbscan(vectors(spark, data), "id", "vec", 0.05, min_samples, INDEXED))
    assert got == brute_dbscan(data.astype(np.float64), 0.05, min_samples)


def test_metric_index_gives_all_pairs(spark):
    df = vectors(spark, clustered(15, 10, 6, 9, 0.2))
    want, got = ({(r.left_id, r.right_id) for r in eps_join(df, "id", "vec", 0.1, p).collect()} for p in (Params(), INDEXED))
    assert want == got and want


def test_metric_index_skips_most_pairs_of_clustered_vectors(spark):
    from storygraph.operators.block_join import make_blocks

    data = clustered(40, 25, 32, 6)
    nodes = vectors(spark, data).withColumnRenamed("id", "node")
    placed = make_blocks(nodes, "node", 1000, 100, 0, math.acos(0.9))
    assert placed.index.counts.sum() == 1000
    assert placed.index.compared(placed.reach) < 1000 * 999 / 2 / 4
    assert placed.spread().count() < 1000 * placed.total / 2


@pytest.mark.parametrize("min_samples, params", [(2, Params()), (3, INDEXED)])
def test_batches_give_the_labels_of_one_run(spark, min_samples, params):
    from storygraph.operators.dbscan import empty_density, grow

    data = np.concatenate([clustered(10, 9, 5, 11, 0.3), clustered(1, 8, 5, 12, 0.0)])
    order = np.random.default_rng(1).permutation(len(data))
    whole = vectors(spark, data)
    state = empty_density(whole, "id")
    at = 0
    for size in (40, 1, len(data) - 41):
        ids = order[at : at + size].tolist()
        state = grow(state, whole.filter(F.col("id").isin(ids)), "id", "vec", 0.06, min_samples, params)
        at += size
        assert (state.fresh, state.compared) == (size, at)
        part = {i: data[i] for i in sorted(order[:at].tolist())}
        names = list(part)
        want = brute_dbscan(np.array([part[i] for i in names], np.float64), 0.06, min_samples)
        assert labels(state.points) == {names[i]: None if c is None else names[c] for i, c in want.items()}
    open_rows = {r.id for r in state.points.filter("not core").collect()}
    assert all(r.a in open_rows or r.b in open_rows for r in state.links.collect())
    assert labels(grow(state, whole.limit(0), "id", "vec", 0.06, min_samples, params).points) == labels(state.points)


def test_articles_meet_few_blocks_of_clustered_clusters(spark):
    from storygraph.operators.metric_index import build_metric_index
    from storygraph.operators.nearest import _asked, assign_to_clusters

    data = clustered(30, 10, 16, 8)
    rows = [(f"c{i:03d}", v.tolist(), i % 3) for i, v in enumerate(data)]
    clusters = spark.createDataFrame(rows, CLUSTERS)
    articles = vectors(spark, clustered(30, 10, 16, 8)[::3] + np.float32(0.01))
    params = Params(block_rows=20)
    got = [
        {r.id: (r.cluster_id, round(r.similarity, 9)) for r in assign_to_clusters(articles, clusters, "id", "vec", 0.5, params, m).collect()}
        for m in ("broadcast", "blocks")
    ]
    assert got[0] == got[1] and len(got[0]) == 100
    _, index = build_metric_index(clusters.select("cluster_id", F.col("cluster_embedding").alias("vec")), "cluster_id", 300, 20)
    again = articles.withColumn("similarity", F.lit(0.99))
    assert _asked(articles, "id", index).count() + _asked(again, "id", index).count() < 100 * index.blocks / 2


CLUSTERS = "cluster_id string, cluster_embedding array<float>, last_updated bigint"


@pytest.mark.parametrize("mode", ["broadcast", "blocks"])
def test_nearest_cluster_ties_zero_vectors_and_threshold(spark, mode):
    clusters = spark.createDataFrame(
        [("late", [1.0, 0.0], 9), ("early", [1.0, 0.0], 5), ("same", [1.0, 0.0], 5), ("zero", [0.0, 0.0], 1), ("up", [0.0, 1.0], 1)],
        CLUSTERS,
    )
    articles = plane(spark, [0, 90, 45, 225]).unionByName(spark.createDataFrame([(9, [0.0, 0.0])], SCHEMA))
    params = Params(block_rows=2)
    got = assign_to_clusters(articles, clusters, "id", "vec", 0.7, params, mode)
    rows = {r.id: r.cluster_id for r in got.collect()}
    assert rows[0] == "early" and rows[1] == "up" and rows[3] is None and 9 not in rows
    assert rows[2] in ("up", "early")


def test_broadcast_and_blocks_agree(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], SCHEMA)
    rows = [(f"c{i}", v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(70, 8)))]
    c = spark.createDataFrame(rows, CLUSTERS)
    results = [
        {r.id: (r.cluster_id, round(r.similarity, 9)) for r in assign_to_clusters(a, c, "id", "vec", 0.5, Params(block_rows=16), m).collect()}
        for m in ("broadcast", "blocks")
    ]
    assert results[0] == results[1] and len(results[0]) == 200


def test_no_clusters_leaves_all_unassigned(spark):
    got = assign_to_clusters(plane(spark, [0, 90]), spark.createDataFrame([], CLUSTERS), "id", "vec", 0.7)
    assert [r.cluster_id for r in got.collect()] == [None, None]


def test_kernels_decide_in_double():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    full = a @ a.T
    bar = np.sort(full[np.triu_indices(300, 1)])[-50]
    got = {(int(x), int(y)) for i, j in similar_tiles(a, a, bar - 1e-15, True) for x, y in zip(i, j)}
    want = {(x, y) for x, y in zip(*np.nonzero(np.triu(full, 1) >= bar - 1e-15))}
    assert got == want
    arg, best = best_match(a[:50], a[50:])
    assert (arg == (a[:50] @ a[50:].T).argmax(axis=1)).all()
