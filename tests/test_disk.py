import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from storygraph.operators.dbscan import dbscan
from storygraph.session import materialize
from test_vectors import SCHEMA, brute_dbscan, labels


def test_what_a_step_has_shuffled_goes_with_it(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum("shuffle_" in str(files.getAllFiles().apply(k)) for k in range(files.getAllFiles().size()))

    before = shuffled()
    table, seen = materialize(spark.range(20000).repartition(7).groupBy((F.col("id") % 500).alias("k")).count())
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and seen["rows"] == 500 == table.count()


@pytest.mark.parametrize("min_samples", [2, 4])
def test_pairs_of_many_blocks_go_through_in_turns(spark, monkeypatch, min_samples):
    from storygraph.operators import block_join as J

    monkeypatch.setattr(J, "COPIES", 2)
    written, plain = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df: (written.append(1), plain(df))[1])
    rng = np.random.default_rng(7)
    data = np.concatenate([np.ones((150, 8)) + rng.normal(scale=0.3, size=(150, 8)), rng.normal(size=(150, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA)
    got = labels(dbscan(df, "id", "vec", 0.05, min_samples, blocks=6))
    assert got == brute_dbscan(data.astype(np.float64), 0.05, min_samples)
    # All 7 copies of 6 blocks were on disk at once.
    assert len(written) >= 3
    turns = J.Blocks(df, 29).turns()
    assert [b for first, last in turns for b in range(first, last + 1)] == list(range(29))
    assert all(sum(2 * (29 - b) / 29 for b in range(first, last + 1)) < 2 + 2 for first, last in turns)
