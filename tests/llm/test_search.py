"""Ranked search and hard negatives against brute force, with every odd case."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storygraph.llm.hard_negatives import Lists, best_rows, hard_negatives
from storygraph.llm.lexical_search import Questions, build_index, counted_documents, impact, ranked_search, terms_of

DOCS = "doc_id long, text string, item_id int, m int, term string, block long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    terms = [Counter(split(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = set()
    for item, text in set(items):
        scored = []
        for (doc, _), c, size in zip(docs, terms, sizes, strict=True):
            m = 100 - 50 + (50 * size * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out |= {(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)}
    return out


def test_terms_are_the_matches_of_the_pattern():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("aZ09 .,_@[`{\x7f\x00\n\xa0éÉ日 \x85") for _ in range(40))
        assert [t.decode() for t in terms_of(text)] == split(text)


@pytest.mark.parametrize("block_docs, group_terms", [(2048, 500_000), (3, 10)])
def test_search_equals_brute_force(spark, block_docs, group_terms):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "x9"]
    docs = [(i, " ".join(draw.choices(words, weights=range(1, 63), k=draw.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, "W1 w2, w2 copy") for i in range(40)]
    docs += [(None, "w1 w2"), (None, ""), (2000, None), (2001, ""), (2002, "..."), (7, "w1 again"), (7, "w1 again"), (2003, "w5 " * 30000)]
    items = [(1, "w1 W2 w2 copy"), (2, "w61 x9 é w30"), (3, None), (4, ""), (5, "unheard of"), (6, "w59 w58 w57"), (None, "w3"), (1, "w1 W2 w2 copy"), (8, "É x9")]
    frame = spark.createDataFrame([(*d, 1, 2, "t", 3) for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, doc_id int")
    found = ranked_search(frame, asked, k=20, block_docs=block_docs, group_terms=group_terms).collect()
    assert len(found) == len({(r.item_id, r.rank) for r in found})
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in found} == ranked(docs, items, 20)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, "t", 3)], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0


def test_bounds_hold_for_every_document_of_a_block(spark):
    docs = [(i, " ".join(["a"] * (i % 4) + ["b"] * (i % 3) + ["c"] * 9)) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    counted, n, total = counted_documents(frame, {b"a": 0, b"b": 1, b"c": 2}, "doc_id", "text")
    blocks = build_index(counted, n, total, block_docs=16).collect()
    assert sum(len(b.ids) for b in blocks) == 200 and max(len(b.ids) for b in blocks) <= 16
    assert len({b.block for b in blocks}) == len(blocks)
    questions = Questions([[0, 1], [2]], np.array([5, 7, 11]))
    for b in blocks:
        assert {50 + 50 * len(docs[i][1].split()) * n // total for i in b.ids} == {b.m}
        bounds = questions.bounds(b.m, np.array(b.term), np.array(b.tf))
        for i in b.ids:
            c = Counter(docs[i][1].split())
            assert bounds[0] >= sum(w * int(impact(np.array([c[t]]), b.m)[0]) for t, w in (("a", 5), ("b", 7)))


def brute_negatives(rows, anchors):
    clean = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and None not in v and all(map(math.isfinite, v))}
    out = set()

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    for a, lab, v in clean:
        if not anchors(a):
            continue
        scored = sorted((-dot(v, w), i, m) for i, m, w in clean if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            window = [x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out |= {(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("block_rows", [32_768, 40])
def test_hard_negatives_equal_brute_force(spark, block_rows):
    draw = np.random.default_rng(4)
    rows = [(i, int(draw.integers(0, 4)), draw.normal(size=8).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, rows[0][2]) for i in range(60)]  # one vector under two labels, many times
    rows += [(460 + i, 1, [0.0] * 8) for i in range(9)]
    rows += [(470, 2, None), (480, None, [1.0] * 8), (None, 1, [1.0] * 8), (490, 1, [1.0] * 7 + [None]), (500, 1, [float("nan")] * 8), (510, 1, [float("inf")] * 8)]
    rows += [(520, 3, [1.0, 0.5]), (530, 9, [0.1] * 8), rows[10], rows[10], (540, 2, [])]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, label int, embedding array<float>, node int, ids string")
    rows = [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    found = hard_negatives(frame, F.col("vec_id") % 10 == 0, block_rows=block_rows).collect()
    got = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_lists_are_read_only_as_deep_as_needed():
    draw = np.random.default_rng(0)
    x = draw.integers(-20, 20, (5000, 6))
    x[17] = 200
    lists, anchor = Lists(x), np.full(6, 3)
    seen = 0
    for rows, scores, bound in lists.read(anchor):
        seen += len(rows)
        assert (scores == x[rows] @ anchor).all()
        if bound is not None and bound < 3600:
            break
    assert seen < 300
    ((rows, scores),) = best_rows(lists, anchor, 1)
    assert (rows.tolist(), scores.tolist()) == ([17], [3600])
