"""Near duplicates against brute force, held-out accuracy of the classifiers, and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from storygraph.llm import golay, near_dedup, quality, toxicity
from storygraph.llm.near_dedup import near_duplicates, without_near_duplicates
from storygraph.llm.oracle import ORACLE
from storygraph.llm.quality import quality_scores
from storygraph.llm.queries import REGISTRY
from storygraph.llm.toxicity import toxicity_scores, without_toxic

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, digest int, score int, id int, _digest int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, 2, 3, 4) for r in rows], SCHEMA)


def test_golay_keys():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    near = golay.near(words)
    centres = golay.centre(words)
    assert (near[:, 0] == centres).all()
    for bit in range(23):
        assert (golay.centre(words ^ (1 << bit))[:, None] == near).any(axis=1).all()
        other = golay.near(words ^ (1 << bit) ^ (1 << (bit + 7) % 23))
        assert ((near[:, :, None] == other[:, None, :]) & (near >= 0)[:, :, None]).any(axis=(1, 2)).all()


def test_keys_meet_for_every_split_of_four_errors():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    for errors in range(5):
        flips = [sum(1 << int(b) for b in rng.choice(64, errors, replace=False)) for _ in base]
        other = base ^ np.array(flips, dtype=np.uint64)
        for u, v in zip(base[:300], other[:300], strict=True):
            keys = [set(near_dedup.fuzzy_keys(np.array([x]))[0].tolist()) for x in (u, v)]
            asks = [{k >> 1 for k in s if not k & 1} for s in keys]
            answers = [{k >> 1 for k in s if k & 1} for s in keys]
            exact = [{k for k in s if k >> 35 >= len(near_dedup.PAIRS)} for s in answers]
            assert asks[0] & answers[1] or asks[1] & answers[0] or exact[0] & exact[1]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    groups = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for f in groups[b]:
                    groups[f] = groups[a]
    return groups


def near_rows():
    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(300)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(300)] = "changed"
            rows.append((len(rows) * 3 + g, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "a b c"), (3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (None, "only null"), (906, "long " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, large", [(48, 20_000), (2, 20_000), (2, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, large):
    monkeypatch.setattr(near_dedup, "SMALL_GROUP", small)
    monkeypatch.setattr(near_dedup, "LARGE_GROUP", large)
    rows = near_rows()
    docs = table(spark, rows)
    out = near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    groups = plain_components({plain_fingerprint(t) for _, t in rows})
    least = {}
    for i, t in rows:
        for f in groups[plain_fingerprint(t)]:
            least[f] = min(least.get(f, (i is None, i or 0)), (i is None, i or 0))
    for r in out:
        null, best = least[r.fp % (1 << 64)]
        assert r.component_id == (None if null else best)
    kept = without_near_duplicates(docs).collect()
    assert Counter(plain_fingerprint(r.text) in groups for r in kept) == {True: len({id(g) for g in groups.values()})}
    assert without_near_duplicates(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0 and without_near_duplicates(docs.limit(0)).count() == 0


def labelled(spark, toxic=0.3):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        bad, low = rng.random() < toxic, rng.random() < 0.3
        if bad:
            for _ in range(max(1, len(words) // 30)):
                words.insert(rng.randrange(len(words)), "grum" + rng.choice(["sh", "ff", "zz", "pt", "x"]))
        if low:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 7 else int(not low), int(bad)))
    rows += [(None, "ba do"), (1000, None), (1001, ""), (1002, "ki " * 50000), (5, rows[5][1])]
    return rows, table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, truth):
    held = [r for r in out if r.held_out and truth.get(r.doc_id) is not None]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_rows(spark):
    rows, docs, labels = labelled(spark)
    out = quality_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert accuracy(out, {r.doc_id: r.quality for r in labels.collect()}) > 0.97
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_difference_of_two_normal_densities():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 2, 0], [0, 0, 1]]) + 1
    y = rng.random(300) < 0.4
    x[y] *= 1.5
    parts = [x[~y], x[y]]
    counts = np.array([len(p) for p in parts], float)
    model = quality.fit_discriminant(counts, np.array([p.sum(0) for p in parts]), np.array([p.T @ p for p in parts]), 0.1)
    pooled = np.diag(sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts)) / counts.sum()
    logs = []
    for p in parts:
        covariance = 0.9 * np.cov(p.T, bias=True) + 0.1 * np.diag(pooled)
        d = x - p.mean(0)
        logs.append(np.log(len(p) / 300) - 0.5 * np.log(np.linalg.det(covariance)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariance), d))
    assert model.probability(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))
    assert quality.fit_discriminant(np.array([0.0, 3.0]), np.zeros((2, 3)), np.zeros((2, 3, 3))) is None


def test_toxicity_on_held_out_rows(spark):
    rows, docs, labels = labelled(spark)
    out = toxicity_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert accuracy(out, {r.doc_id: r.toxic for r in labels.collect()}) > 0.97
    again = {(r.doc_id, r.score) for r in toxicity_scores(docs, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in out}
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in out if not r.predicted)
    assert without_toxic(docs, labels.limit(0)).count() == len(rows)
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_models_of_both_classes_are_distributions():
    ordinary, toxic = Counter(), Counter()
    for counts, words in ((ordinary, ["abab", "abba", "baab"]), (toxic, ["abzz", "zzab"])):
        for w in words:
            counts.update(toxicity.grams(w))
    below = toxicity.shared_backoff(set(ordinary) | set(toxic))
    sums = defaultdict(float)
    for g, p in below.items():
        sums[g[:-1]] += p
    # What a context lacks of 1 is what it leaves to characters never seen after it.
    assert all(0 < s <= 1 + 1e-9 for s in sums.values())
    names = sorted(set(ordinary) | set(toxic))
    known = toxicity.Grams(pa.array(names))
    counts = [np.array([c[g] for g in names], float) for c in (ordinary, toxic)]
    ratios = toxicity.WordRatios(known.ratios(*counts))
    assert ratios[b"zzab"] > 1 and ratios[b"abba"] < 0.1
    assert not known.ratios(counts[0] * 0, counts[1]).gram.any()
    # The probabilities behind the ratios, spelled out for one gram of either class.
    h = names[0][:-1]
    p = []
    for c in (ordinary, toxic):
        whole, kinds = sum(n for g, n in c.items() if g[:-1] == h), sum(g[:-1] == h for g in c)
        p.append((max(c[names[0]] - 0.75, 0) + 0.75 * kinds * below[names[0][1:]]) / whole if whole else below[names[0][1:]])
    assert known.ratios(*counts).gram[0] == pytest.approx(np.log(p[1] / p[0]))


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    left = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, left, DATA)
        assert out.columns == columns, name
        before, after = Counter(left.collect()), Counter(out.collect())
        assert not after - before and sum(after.values()) >= 0.6 * sum(before.values())
        left = out
    assert len({r.doc_id for r in left.collect()}) == left.count()
    texts = [" ".join(r.text.lower().split()) for r in left.collect()]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [t for t in texts if any(i in t for i in items)]
    final = corpus_pipeline.run(spark, DATA).collect()
    kept = Counter(r.doc_id for r in final)
    assert set(kept) <= {r.doc_id for r in left.collect()} and max(kept.values()) <= 2
    assert all(0 <= r.shard < 24 for r in final)
    for odd in (docs.limit(0), docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None,) * 5], docs.schema))):
        for _, stage in corpus_pipeline.STAGES:
            odd = stage(spark, odd, DATA)
        odd.collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = REGISTRY[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 11))


def test_copies_take_no_places_of_the_toxicity_sample(spark):
    from storygraph.llm.toxicity import labelled_sample

    rows = [(i, "one text in many copies" if i < 300 else f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, toxic int")
    picked = labelled_sample(docs, labels, "doc_id", "text", "toxic", 5, 50).collect()
    assert len(picked) == 50 == len({r.digest for r in picked})
