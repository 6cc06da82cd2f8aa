"""Language-model scores by subword lattices.

A public vocabulary gives the pieces and their weights. The probability of a word is the sum
over all its segmentations into pieces, by the forward recursion in log space, and that of a
document the product over its words and its end: the marginal over all segmentations of the
whole text, as no piece reaches over a blank. The given weights are fitted to the training
rows by one round of expectation maximisation, every word counting as often as it occurs;
documents end as often as they do there. Words are counted over the whole corpus, without a
limit: the most frequent ones are broadcast, up to a fixed number, and all other words of a
document meet their scores in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.llm import lattice
from storygraph.llm.columns import fold
from storygraph.session import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
END = " "  # the end of a document; no word holds a space
PRIOR = 1000.0  # occurrences that the given weights count for
ROUNDS = 1
FREQUENT = 200_000  # words that are broadcast at most
FLUSH = 200_000
CHUNK = 20_000
LN10 = float(np.log(10.0))


def count_words(docs: DataFrame, text_col: str, training) -> tuple[DataFrame, dict]:
    """(word, c) of all words, c counted in training rows only, and the sums: tokens, types, ends."""
    rows = docs.select(training.alias("training"), docs[text_col].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter = Counter()
        other: set = set()

        def flush() -> Iterator[pa.RecordBatch]:
            names = [*learned, *(w for w in other if w not in learned)]
            n = [*learned.values(), *[0] * (len(names) - len(learned))]
            for at in range(0, len(names), CHUNK):
                words = [w.decode("utf-8", "surrogatepass") for w in names[at : at + CHUNK]]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n[at : at + CHUNK], pa.int64())], ["word", "n"])
            learned.clear()
            other.clear()

        for batch in batches:
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                if train:
                    learned.update(words)
                    learned[b" "] += 1
                else:
                    other.update(words)
            if len(learned) + len(other) > FLUSH:
                yield from flush()
        yield from flush()

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    return materialize(counted, tokens=F.sum("c"), types=F.count_if(F.col("c") > 0), ends=F.sum(F.when(F.col("word") == END, F.col("c"))))


def fit_pieces(words: DataFrame, start: lattice.Vocabulary, rounds: int = ROUNDS, prior: float = PRIOR) -> lattice.Vocabulary:
    """Piece weights fitted to the training words, each as often as it occurs."""
    sc = words.sparkSession.sparkContext
    types = words.filter((F.col("c") > 0) & (F.col("word") != END)).select("word", F.col("c").cast("double").alias("c"))
    current = start
    for _ in range(rounds):
        shared = sc.broadcast(current)

        def expect(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shared.value.size)
            for batch in batches:
                names, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for at in range(0, len(names), CHUNK):
                    total += lattice.expected_counts(names[at : at + CHUNK], c[at : at + CHUNK], shared.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        # One row per piece of the given vocabulary at most.
        sums = types.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros(start.size)
        expected[sums["piece"].to_numpy()] = sums["n"].to_numpy()
        weights = expected + prior * np.exp(start.scores)
        current = lattice.Vocabulary(start.ids, np.log(weights / weights.sum()))
    return current


def word_scores(words: DataFrame, pieces: lattice.Vocabulary, n: int, v: int, ends: int) -> DataFrame:
    """(word, c, known, base, score) of every word, logarithms to base 10; ``ends`` of the n training tokens are ends."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)
    stop = end_probability(n, ends)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            inside = np.concatenate([lattice.log_likelihoods(names[at : at + CHUNK], shared.value) for at in range(0, len(names), CHUNK)])
            # The end of a document has no pieces; a word comes where the document does not end.
            total = np.where(np.array(names, dtype=object) == END, np.log(stop), inside + np.log1p(-stop)) / LN10
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(total)],
                ["word", "c", "known", "base", "score"],
            )

    return words.mapInArrow(score, "word string, c long, known long, base double, score double")


def end_probability(n: int, ends: int) -> float:
    """How likely a token is the end of its document, by the training rows with one of each kind added."""
    return (ends + 1) / (n + 2)


def frequent_words(scored: DataFrame, most: int = FREQUENT) -> dict[str, tuple[int, float, float]]:
    """The words from a count on that at most ``most`` words reach; the rest is left to the join."""
    level = F.floor(F.log2(F.col("c")) * 8)
    steps = sorted(((r.level, r.n) for r in scored.filter("c > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    cut, total = None, 0
    for step, n in steps:
        if (total := total + n) > most:
            break
        cut = step
    if cut is None:
        return {}
    table = scored.filter((F.col("c") > 0) & (level >= F.lit(cut))).select("word", "known", "base", "score").toArrow()
    return dict(zip(table["word"].to_pylist(), zip(*(table[c].to_pylist() for c in ("known", "base", "score")), strict=True), strict=True))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Rows whose fold is 0 are held out, all others train; a null id trains. Tokens are the
    words and one end; a null text counts as empty and has the end alone. Repeated rows
    train as often as they occur and each have their scores. ``score`` is the log10
    probability of the text, summed over all segmentations of all words, known or not;
    ``base_score`` that of smoothed word frequencies. Other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held_out = fold(docs[id_col], folds) == 0
    words, seen = count_words(docs, text_col, ~held_out)
    n, v = seen["tokens"] or 0, seen["types"] or 0
    pieces = fit_pieces(words, lattice.load_vocabulary(vocabulary))
    ends = seen["ends"] or 0
    scored, _ = materialize(word_scores(words, pieces, n, v, ends))
    end = (int(ends > 0), float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))), float(np.log10(end_probability(n, ends))))
    shared = spark.sparkContext.broadcast(frequent_words(scored))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w.encode("utf-8", "surrogatepass"): s for w, s in shared.value.items()}
        for batch in batches:
            own, rare_row, rare_word, rare_n = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                total, base, score = end
                for word, times in Counter(words).items():
                    s = known.get(word)
                    if s is None:
                        rare_row.append(row)
                        rare_word.append(word.decode("utf-8", "surrogatepass"))
                        rare_n.append(times)
                    else:
                        total += times * s[0]
                        base += times * s[1]
                        score += times * s[2]
                own.append((len(words) + 1, total, base, score))
            n_tokens, n_known, bases, scores = zip(*own, strict=True) if own else ((), (), (), ())
            m, k = len(own), len(rare_row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.array(rare_row, pa.int64())]),
                    pa.concat_arrays([batch.column(1), pa.nulls(k, batch.column(1).type)]),
                    pa.concat_arrays([batch.column(2), pa.nulls(k, pa.bool_())]),
                    pa.concat_arrays([pa.nulls(m, pa.string()), pa.array(rare_word, pa.string())]),
                    pa.concat_arrays([pa.array(n_tokens, pa.int64()), pa.array(rare_n, pa.int64())]),
                    pa.concat_arrays([pa.array(n_known, pa.int64()), pa.nulls(k, pa.int64())]),
                    pa.concat_arrays([pa.array(bases, pa.float64()), pa.nulls(k, pa.float64())]),
                    pa.concat_arrays([pa.array(scores, pa.float64()), pa.nulls(k, pa.float64())]),
                ],
                ["row", "id", "held_out", "word", "n", "n_known", "base", "score"],
            )

    schema = f"row long, id {kind}, held_out boolean, word string, n long, n_known long, base double, score double"
    parts, _ = materialize(rows.mapInArrow(split, schema))
    own = parts.filter("word IS NULL").select("row", "id", "held_out", F.col("n").alias("n_tokens"), "n_known", "base", "score")
    rare = parts.filter("word IS NOT NULL").select("row", "word", "n").join(scored.select("word", "known", "base", "score"), "word")
    rare = rare.groupBy("row").agg(*[F.sum(F.col("n") * F.col(c)).alias(f"rare_{c}") for c in ("known", "base", "score")])
    joined = own.join(rare, "row", "left")

    def total(own: str, rare: str):
        return F.col(own) + F.coalesce(F.col(rare), F.lit(0))

    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        total("n_known", "rare_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        total("base", "rare_base").alias("base_score"),
        total("score", "rare_score").alias("score"),
    )
