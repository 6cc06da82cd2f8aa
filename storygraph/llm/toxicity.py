"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

A word is a sequence of characters from its start to its end; each model gives the next
character from the five before it, with the counts of its own class. What a class has
not seen is left to lower orders that both share: continuation counts over the pooled
material. So rare and new forms of an expression are judged by the stem they begin with, and
where neither class knows anything the difference is zero. A document is compared by the
difference of its two log-likelihoods, normalised by length: as a whole, in its
most suspicious passage and in its most suspicious word. A logistic function, fitted to
labelled documents that the models have not seen, turns these into a probability. Of two
labels for one id the larger counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph.llm.columns import digest_number, fold
from storygraph.llm.decontaminate import shingle_hashes
from storygraph.session import materialize

ORDER = 6
DISCOUNT = 0.75
PARTS = 3  # of the sample, each measured by models of the others
PASSAGE = 20  # words
FLOOR = -0.02  # toxic documents are ordinary ones but for a few words, so in what is told no word speaks against toxicity by more
SAMPLE = 2000  # labelled documents of each class that are learned from at most
CACHE = 200_000
OPEN, CLOSE = "\x02", "\x03"
FEATURES = ("document", "told", "evidence", "passage", "word", "length")


def grams(word: str) -> list[str]:
    padded = OPEN * (ORDER - 1) + word + CLOSE
    return [padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass(frozen=True)
class Ratios:
    """Log ratio of the classes for each known gram, and for an unknown character after each known context."""

    grams: pa.Array
    gram: np.ndarray
    contexts: pa.Array
    context: np.ndarray

    def lookups(self) -> tuple[dict[str, float], dict[str, float]]:
        gram = dict(zip(self.grams.to_pylist(), self.gram.tolist(), strict=True))
        return gram, dict(zip(self.contexts.to_pylist(), self.context.tolist(), strict=True))


def shared_backoff(known: set[str]) -> dict[str, float]:
    """Kneser-Ney probabilities one order below ``known`` from how many different characters stand before."""
    levels = []
    while len(next(iter(known))) > 1:
        counts = Counter(g[1:] for g in known)
        levels.append(counts)
        known = set(counts)
    total = sum(levels[-1].values())
    p = {g: n / total for g, n in levels[-1].items()}
    for counts in reversed(levels[:-1]):
        whole, kinds = Counter(), Counter()
        for g, n in counts.items():
            whole[g[:-1]] += n
            kinds[g[:-1]] += 1
        p = {g: (n - DISCOUNT + DISCOUNT * kinds[g[:-1]] * p[g[1:]]) / whole[g[:-1]] for g, n in counts.items()}
    return p


class Grams:
    """The distinct grams of the sample with their contexts and shared backoff, as arrays."""

    def __init__(self, grams: pa.Array):
        names = grams.to_pylist()
        contexts = pa.array([g[:-1] for g in names], pa.string()).dictionary_encode()
        self.grams = grams
        self.contexts = contexts.dictionary
        self.context_of = contexts.indices.to_numpy()
        below = shared_backoff(set(names)) if names else {}
        self.below = np.array([below[g[1:]] for g in names])

    def ratios(self, ordinary: np.ndarray, toxic: np.ndarray) -> Ratios:
        """Both models from their counts of the grams, reduced to what is needed: the log ratios."""
        at, size = self.context_of, len(self.contexts)
        gram, context = np.zeros(len(at)), np.zeros(size)
        if ordinary.sum() and toxic.sum():
            for sign, n in ((-1, ordinary), (1, toxic)):
                whole = np.bincount(at, n, size)
                spared = DISCOUNT * np.bincount(at, n > 0, size)
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = (np.maximum(n - DISCOUNT, 0.0) + spared[at] * self.below) / whole[at]
                    left = spared / whole
                gram += sign * np.log(np.where(whole[at] > 0, own, self.below))
                context += sign * np.log(np.where(whole > 0, left, 1.0))
        return Ratios(self.grams, gram, self.contexts, context)


class WordRatios(dict):
    """Log ratio of words, computed once while it is remembered."""

    def __init__(self, ratios: Ratios):
        super().__init__()
        self.gram, self.context = ratios.lookups()

    def __missing__(self, word: bytes) -> float:
        gram, context = self.gram, self.context
        value = 0.0
        for g in grams(word.decode("utf-8", "surrogatepass")):
            known = gram.get(g)
            value += context.get(g[:-1], 0.0) if known is None else known
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def features(text: str | None, ratios: WordRatios) -> list[float]:
    """The length-normalised ratios of a whole text, in the order of ``FEATURES``.

    ``document`` is the difference of the two log-likelihoods as it is; in the others a word
    counts at least ``FLOOR``, so that a long ordinary text does not hide a toxic passage.
    """
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    whole = np.fromiter(map(ratios.__getitem__, words), float, n)
    each = np.maximum(whole, FLOOR)
    sums = np.concatenate([[0.0], np.cumsum(each)])
    passage = (sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE if n > PASSAGE else sums[-1] / max(n, PASSAGE / 2)
    return [float(whole.sum()) / n, sums[-1] / n, sums[-1] / np.sqrt(n), float(passage), float(each.max()), float(np.log1p(n))]


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> Logistic | None:
    """Newton's method with a ridge; None where a class has no row."""
    if len(set(y.tolist())) < 2:
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ b, -500, 500)))
        w = p * (1 - p) + 1e-9
        b += np.linalg.solve((a.T * w) @ a + ridge * np.eye(len(b)), a.T @ (y - p) - ridge * b)
    return Logistic(mean, scale, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, sample: int) -> DataFrame:
    """(id, label, order, digest): up to ``sample`` different texts of each class in the order of a hash; copies count once."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id"), folds) != 0))
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label")).withColumn("order", digest_number(F.lit("toxic"), F.col("id")))
    # Only ids and digests meet the labels, no texts.
    texts = docs.select(docs[id_col].alias("id"), _digest(docs[text_col]).alias("digest")).join(known, "id")
    texts = texts.groupBy("label", "digest").agg(F.min(F.struct("order", "id")).alias("one")).select("one.id", "label", "one.order", "digest")
    picked = [texts.filter(F.col("label") == c).orderBy("order", "id", "digest").limit(sample) for c in (0, 1)]
    return picked[0].unionByName(picked[1])


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _measured(rows: DataFrame, ratios: list[Ratios], logistic: Logistic | None = None, probabilities: bool = True) -> DataFrame:
    """``rows`` with their last column, the text, replaced by ``score``, or by the features ``x``.

    With several ratios, the column before the text says which one holds.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ratios)
    names = rows.columns[:-1]
    schema = rows.select(*names).schema.add(*(("score", T.DoubleType()) if probabilities else ("x", T.ArrayType(T.DoubleType()))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, WordRatios] = {}
        for batch in batches:
            texts = batch.columns[-1].to_pylist()
            which = batch.columns[-2].to_pylist() if len(shared.value) > 1 else [0] * len(texts)
            for i in set(which) - set(known):
                known[i] = WordRatios(shared.value[i])
            x = [features(t, known[i]) for t, i in zip(texts, which, strict=True)]
            if not probabilities:
                out = pa.array(x, pa.list_(pa.float64()))
            else:
                out = pa.array(np.zeros(len(x)) if logistic is None else logistic(np.array(x).reshape(-1, len(FEATURES))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], schema.names)

    return rows.mapInArrow(measure, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, sample: int) -> tuple[Ratios, Logistic | None]:
    """The two models, from a sample of bounded size; grams are counted where the documents are."""
    picked, _ = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, folds, sample))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("digest", _digest(F.col("text"))).join(F.broadcast(picked), ["id", "digest"])
    texts = texts.groupBy("label", "digest").agg(F.min(F.struct("order", "id", "text")).alias("one"))
    # Texts with the same smallest shingle are measured by models that saw none of them.
    key = F.coalesce(F.array_min(shingle_hashes(F.col("one.text"))), F.lit(0))
    texts, _ = materialize(texts.select("one.id", "label", F.pmod(key, F.lit(PARTS)).cast("int").alias("part"), "one.text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
        for batch in batches:
            for label, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen[label, part].update(words_of(text))
        for (label, part), words in seen.items():
            total: Counter = Counter()
            for word, n in words.items():
                for g in grams(word.decode("utf-8", "surrogatepass")):
                    total[g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                ["label", "part", "gram", "n"],
            )

    counted = texts.select("label", "part", "text").mapInArrow(count, "label int, part int, gram string, n long")
    table = counted.groupBy("label", "part", "gram").agg(F.sum("n").alias("n")).toArrow()
    coded = table["gram"].combine_chunks().dictionary_encode()
    known = Grams(coded.dictionary)
    counts = np.zeros((2, PARTS, len(coded.dictionary)))
    counts[table["label"].to_numpy(), table["part"].to_numpy(), coded.indices.to_numpy()] = table["n"].to_numpy()
    del table, coded
    # Each part is measured by models of the others.
    whole = counts.sum(axis=1)
    others = [known.ratios(*(whole - counts[:, p])) for p in range(PARTS)]
    measured = _measured(texts.select("id", "label", "part", "text"), others, probabilities=False)
    measured = measured.orderBy("id", "label").toArrow()
    x = np.array(measured["x"].to_pylist()).reshape(-1, len(FEATURES))
    logistic = fit_logistic(x, measured["label"].to_numpy().astype(float))
    return known.ratios(*whole), logistic


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    sample: int = SAMPLE,
    threshold: float = 0.5,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Learns from labelled rows whose fold is not 0, up to ``sample`` different texts of each class by
    a hash of their id; all else covers all rows and whole texts. Null labels and null ids teach nothing.
    ``score`` is the probability of label 1, also for null and empty texts; without a row
    of either class it is 0. Repeated rows score alike. Columns besides id and text are no
    input; an empty table gives an empty result.
    """
    ratios, logistic = fit(docs, labels, id_col, text_col, label_col, folds, sample)
    scored = _measured(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), [ratios], logistic)
    return scored.select(
        F.col("id").alias(id_col), (fold(F.col("id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    sample: int = SAMPLE,
    threshold: float = 0.5,
) -> DataFrame:
    """``docs`` without the rows predicted toxic, columns unchanged; no shuffle of texts."""
    ratios, logistic = fit(docs, labels, id_col, text_col, label_col, folds, sample)
    # Columns are known by their place, whatever they are called.
    places = [f"c{i}" for i in range(len(docs.columns))]
    scored = _measured(docs.toDF(*places).select(*places, F.col(places[docs.columns.index(text_col)]).alias("text")), [ratios], logistic)
    return scored.filter(F.col("score") < threshold).drop("score").toDF(*docs.columns)
