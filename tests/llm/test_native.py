"""Exact dedup, sharding, mixing and decontamination on small tables with every odd case."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storygraph.llm.columns import word_count
from storygraph.llm.decontaminate import block_keys, leaks, without_leaks
from storygraph.llm.exact_dedup import exact_duplicates
from storygraph.llm.mixing import mixed, source_targets, with_copies
from storygraph.llm.sharding import assign_shards, number_slots

SCHEMA = "doc_id long, text string, source string, run int, copies int, row_key string, mix int, _bucket int"


def table(spark, rows):
    """Rows of (doc_id, text, source) with extra columns named like internal ones."""
    return spark.createDataFrame([(*r, 7, 8, "k", 9, 1) for r in rows], SCHEMA)


ODD = [(1, "same text", "a"), (2, "same text", None), (5, None, "a"), (6, "", "b"), (7, "x " * 40000, "b"), (8, "same text", "a"), (8, "same text", "a"), (None, "same text", "c"), (None, "alone", None), (9, "Same text", "a")]


def test_exact_duplicates(spark):
    rows = exact_duplicates(table(spark, ODD), keep="largest", runs=8, fan_in=2).collect()
    assert len(rows) == len(ODD)
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    want = defaultdict(list)
    for i, t, _ in ODD:
        want[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert set(groups) == set(want)
    for sha, ids in want.items():
        best = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in groups[sha]} == {(best, len(ids))}
        assert [r.doc_id for r in groups[sha] if r.kept] == [best]
    least = exact_duplicates(table(spark, ODD)).filter("text_sha256 = sha2('same text', 256)").collect()
    assert {r.keep_id for r in least} == {1}


@pytest.mark.parametrize("runs, fan_in", [(1, 8), (64, 8), (10, 3)])
def test_exact_duplicates_do_not_depend_on_the_tree(spark, runs, fan_in):
    docs = table(spark, [(i, f"text {i % 37}", "s") for i in range(400)])
    rows = exact_duplicates(docs, runs=runs, fan_in=fan_in).collect()
    assert all(r.keep_id == r.doc_id % 37 for r in rows)
    assert sum(r.kept for r in rows) == 37


def test_runs_are_merged_in_order(spark):
    from storygraph.llm.exact_dedup import merged

    rows = [(r, d % 3, bytes([d]), 1, 5, None if r == 0 else 10 * r + d, 1 + r) for r in range(4) for d in range(6)]
    runs = spark.createDataFrame(rows, "run int, slice int, digest binary, n_bytes int, second long, keep_id long, n long")
    halves = merged(runs.withColumn("run", F.floor(F.col("run") / 2).cast("int")), F.col("keep_id").asc_nulls_last())
    plan = halves._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [run") == 1 and "Window" in plan and "Aggregate" not in plan
    got = {(r.run, bytes(r.digest)[0]): (r.keep_id, r.n) for r in halves.collect()}
    assert got == {(h, d): (10 + d if h == 0 else 20 + d, 3 if h == 0 else 7) for h in (0, 1) for d in range(6)}
    # Entries that agree in the digest alone are not one.
    odd = runs.withColumn("run", F.lit(0)).withColumn("n_bytes", F.col("n").cast("int"))
    assert merged(odd, F.col("keep_id").asc_nulls_last()).count() == 24


def test_a_row_repeated_many_times(spark):
    docs = spark.range(3500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = exact_duplicates(docs).collect()
    assert len(rows) == 3500 and {r.group_size for r in rows} == {3500} and sum(r.kept for r in rows) == 1


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_duplicates(docs).count() == 0
    assert number_slots(assign_shards(docs.select("doc_id"), [1.0, 1.0])).count() == 0
    assert mixed(docs, word_count(F.col("text")), [F.col("doc_id")]).count() == 0
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id int, text string")
    assert leaks(docs, bench).count() == 0
    assert leaks(table(spark, ODD), bench.limit(0)).count() == 0


def test_shards_move_only_into_the_new_one(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"))
    rows = assign_shards(assign_shards(ids, [1.0] * 6), [1.0] * 7, shard_col="grown").collect()
    assert all(r.grown in (r.shard, 6) for r in rows)
    assert 300 < sum(r.grown == 6 for r in rows) < 560
    heavy = Counter(r.shard for r in assign_shards(ids, [1.0, 3.0, 0.0]).collect())
    assert set(heavy) == {0, 1} and 2.5 < heavy[1] / heavy[0] < 3.6


def test_slots_have_no_gaps_and_repeated_rows_get_their_own(spark):
    rows = [(i % 50 if i < 500 else None, i % 7) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, _copies int")
    out = number_slots(assign_shards(docs, [1.0] * 5)).collect()
    assert Counter((r.doc_id, r._copies) for r in out) == Counter(rows)
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 700}, {"a": 5, "b": 900, "c": 1}, {"a": 0, "b": 10}, {"x": 3}])
def test_targets_are_the_water_level(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = table(spark, [(i, "w " * (1 + i % 9), ("a", "b", None)[i % 3]) for i in range(3000)])
    size, key = word_count(F.col("text")), [F.col("doc_id")]
    rows = with_copies(docs, size, key, into="drawn").select("doc_id", "source", "drawn.*").collect()
    taken = Counter()
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for source, target in {(r.source, r.target) for r in rows}:
        assert taken[source] == pytest.approx(target, rel=0.1)
    again = Counter(r.doc_id for r in mixed(docs, size, key).collect())
    assert again == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixed(docs, size, key).columns == docs.columns


@pytest.mark.parametrize("few", [100_000, 0])
def test_odd_rows_are_mixed(spark, monkeypatch, few):
    from storygraph.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    docs = table(spark, [*ODD, (11, "w " * 50000, None), (12, "a b", "c"), (12, "a b", "c")])
    size, key = word_count(F.col("text")), [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))]
    rows = with_copies(docs, size, key, into="drawn").select("doc_id", "text", "source", "drawn.*").collect()
    sizes = Counter()
    for r in rows:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 2
        sizes[r.source] += r.size
    assert len(rows) == len(ODD) + 3
    targets = brute_targets(dict(sizes))
    assert {(r.source, r.source_size) for r in rows} == set(sizes.items())
    assert {r.source: r.target for r in rows} == pytest.approx(targets)
    # Repeated rows are drawn alike; null and empty texts have no size and meet any target.
    assert len({r.copies for r in rows if r.doc_id == 12}) == 1
    again = Counter((r.doc_id, r.text, r.source) for r in mixed(docs, size, key).collect())
    assert again == Counter(k for r in rows for k in [(r.doc_id, r.text, r.source)] * r.copies)


WORDS = [f"w{i}" for i in range(400)]


def passage(at, n, step=1):
    return " ".join(WORDS[(at + i * step) % 400] for i in range(n))


def test_leaks_equal_brute_force(spark):
    bench = [(1, passage(0, 30)), (2, passage(200, 18, 3)), (3, None), (4, ""), (5, "only three words"), (6, passage(0, 30))]
    edited = passage(0, 30).split()
    edited[2] = "changed"
    docs = [
        (1, "before " + passage(0, 30) + " after", "s"),
        (2, passage(100, 60), "s"),
        (3, passage(50, 20) + ", " + passage(200, 18, 3).upper() + "! " + passage(90, 10), "s"),
        (4, "some " + " ".join(edited) + " more", "s"),
        (5, passage(0, 15), "s"),
        (6, None, "s"),
        (7, "", "s"),
        (8, "Only three words.", "s"),
        (9, "not only three words here", "s"),
        (10, passage(0, 28), "s"),
        (1, "before " + passage(0, 30) + " after", "s"),
        (None, passage(0, 30), "s"),
        (11, ("z " * 30000) + passage(200, 18, 3), "s"),
    ]

    def shingles(text):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []

    want = {}
    for i, text, _ in docs:
        s = shingles(text)
        for item, item_text in bench:
            b = shingles(item_text)
            best = 0.0
            for at in range(max(1, len(s) - len(b) + 1)) if b and s else ():
                w, c = Counter(s[at : at + len(b)]), Counter(b)
                common = sum((w & c).values())
                best = max(best, common / (sum(w.values()) + len(b) - common))
            if best >= 0.8:
                want[i, item] = best
    frame = table(spark, docs)
    items = spark.createDataFrame(bench, "item_id int, text string")
    got = leaks(frame, items).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want)
    assert {i for i, _ in want} == {1, 3, 8, 10, 11, None} and (4, 1) not in want
    clean = without_leaks(frame, items)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6, 7, 9]


def test_block_index_finds_everything_within_the_radius(spark):
    rows = spark.range(200).select(F.xxhash64("id").alias("a"), F.col("id"))
    # Turn `radius` bits, spread as evenly over the blocks as can be: the worst case.
    turned = F.col("a")
    for bit in range(0, 64, 4):
        turned = turned.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), bit))
    rows = rows.withColumn("b", turned)
    met = rows.filter(F.arrays_overlap(block_keys(F.col("a"), 16, 9, turned=True), block_keys(F.col("b"), 16, 9)))
    assert rows.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) == 16).count() == 200
    assert met.count() == 200
