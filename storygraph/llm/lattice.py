"""Subword lattices of words: forward and backward recursion in log space, over many words at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

START = "▁"  # stands for the space before a word, as in the vocabulary
BYTE_PIECES = 256
CHARACTERS = 0x110000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in order; the first 256 are single bytes, the last word of any character the others lack."""

    ids: dict[str, int]  # of every piece, and -1 for every other beginning of one
    scores: np.ndarray  # log weights, summing up to 1 as probabilities

    @property
    def size(self) -> int:
        return len(self.scores)

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, children, pieces): a key is a node and the next character, the root is node 0; pieces by node, -1 for none."""
        number = {name: i for i, name in enumerate(self.ids, start=1)}
        keys = np.array([number.get(name[:-1], 0) * CHARACTERS + ord(name[-1]) for name in self.ids], np.int64)
        order = np.argsort(keys)
        return keys[order], order + 1, np.array([-1, *self.ids.values()], np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece file, read where the driver runs.

    Scores of a merge vocabulary are ranks below zero: a piece's weight is taken as
    1 / (1 + rank). Bytes share the weight of the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, ranks = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            names.append(model.id_to_piece(i))
            ranks.append(-model.get_score(i))
    return make_vocabulary(names, ranks)


def make_vocabulary(names: list[str], ranks: list[float]) -> Vocabulary:
    ids: dict[str, int] = {}
    for i, name in enumerate(names):
        ids[name] = BYTE_PIECES + i
        for end in range(1, len(name)):
            ids.setdefault(name[:end], -1)
    last = max(ranks, default=0.0)
    weights = 1.0 / (1.0 + np.array([last] * BYTE_PIECES + list(ranks)))
    return Vocabulary(ids, np.log(weights / weights.sum()))


@dataclass(frozen=True)
class Lattices:
    """All pieces of all words as edges between numbered places; ``first`` has each word's first place, then the total."""

    first: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    piece: np.ndarray
    extra: list[tuple[int, list[int]]]  # (edge, bytes) of characters without a piece


def build(words: list[str], vocabulary: Vocabulary) -> Lattices:
    """All words go down the trie of pieces together, from each of their places, one character a step."""
    keys, children, pieces = vocabulary.trie
    codes = np.frombuffer("".join([START + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    end = np.cumsum(sizes)[word] if len(words) else np.empty(0, np.int64)
    # A word of n characters has n + 1 places.
    place = np.arange(len(codes)) + word
    begin, at, node = np.arange(len(codes)), np.arange(len(codes)), np.zeros(len(codes), np.int64)
    src, dst, piece = [], [], []
    alone = np.zeros(len(codes), bool)
    while len(begin) and len(keys):
        key = node * CHARACTERS + codes[at]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        good = keys[found] == key
        begin, at, node = begin[good], at[good], children[found[good]]
        hit = pieces[node] >= 0
        src.append(place[begin[hit]])
        dst.append(place[at[hit]] + 1)
        piece.append(pieces[node[hit]])
        alone[begin[hit & (at == begin)]] = True
        at = at + 1
        more = at < end[begin]
        begin, at, node = begin[more], at[more], node[more]
    bare = np.flatnonzero(~alone)
    known = sum(map(len, src))
    extra = [(known + k, list(chr(c).encode("utf-8", "surrogatepass"))) for k, c in enumerate(codes[bare].tolist())]
    src, dst, piece = (np.concatenate([*x, y]).astype(np.int64) for x, y in ((src, place[bare]), (dst, place[bare] + 1), (piece, np.full(len(bare), -1))))
    return Lattices(np.r_[0, np.cumsum(sizes + 1)], src, dst, piece, extra)


def _weights(lat: Lattices, scores: np.ndarray) -> np.ndarray:
    out = scores[lat.piece]
    for edge, codes in lat.extra:
        out[edge] = scores[codes].sum()
    return out


def _reach(first: np.ndarray, keys: np.ndarray, others: np.ndarray, weights: np.ndarray, step_of: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """log sum over paths from ``begin`` to every place; ``step_of`` orders places so that edges lead upwards."""
    reach = np.full(first[-1], -np.inf)
    reach[begin] = 0.0
    order = np.lexsort((keys, step_of[keys]))
    keys, others, weights = keys[order], others[order], weights[order]
    steps = step_of[keys]
    bounds = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1], True]) if len(steps) else np.zeros(1, int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        k, value = keys[a:b], reach[others[a:b]] + weights[a:b]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        top = np.maximum.reduceat(value, starts)
        shifted = np.exp(value - np.repeat(top, np.diff(np.r_[starts, len(k)])))
        reach[k[starts]] = top + np.log(np.add.reduceat(shifted, starts))
    return reach


def _forward(lat: Lattices, weights: np.ndarray) -> np.ndarray:
    places = np.arange(lat.first[-1]) - np.repeat(lat.first[:-1], np.diff(lat.first))
    return _reach(lat.first, lat.dst, lat.src, weights, places, lat.first[:-1])


def _backward(lat: Lattices, weights: np.ndarray) -> np.ndarray:
    places = np.repeat(lat.first[1:] - 1, np.diff(lat.first)) - np.arange(lat.first[-1])
    return _reach(lat.first, lat.src, lat.dst, weights, places, lat.first[1:] - 1)


def log_likelihoods(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Natural log of each word's probability, summed over all its segmentations."""
    if not words:
        return np.zeros(0)
    lat = build(words, vocabulary)
    return _forward(lat, _weights(lat, vocabulary.scores))[lat.first[1:] - 1]


def expected_counts(words: list[str], counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How often each piece is expected in the words, each occurring ``counts`` times."""
    out = np.zeros(vocabulary.size)
    if not words:
        return out
    lat = build(words, vocabulary)
    weights = _weights(lat, vocabulary.scores)
    ahead, behind = _forward(lat, weights), _backward(lat, weights)
    word_of = np.searchsorted(lat.first, lat.src, side="right") - 1
    total = ahead[lat.first[1:] - 1]
    share = np.exp(ahead[lat.src] + weights + behind[lat.dst] - total[word_of]) * counts[word_of]
    plain = lat.piece >= 0
    out += np.bincount(lat.piece[plain], share[plain], minlength=vocabulary.size)
    for edge, codes in lat.extra:
        np.add.at(out, codes, share[edge])
    return out
