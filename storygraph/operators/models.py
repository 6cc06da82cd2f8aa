"""The functions that may replace the built-in models."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd

WINDOW_TOKENS = 1 << 20  # blank-separated tokens of a cluster text that a model gets at a time, if it states no other number

EmbedFn = Callable[[pd.Series], pd.Series]  # batch of texts -> batch of vectors
SummaryFn = Callable[[pd.Series], Iterable[str | None]]  # batch of texts -> batch of summaries


class Tokenizer(Protocol):
    """What counts as a token for the summary gate and for the cut before a model that is passed in."""

    def count(self, texts: pd.Series) -> Iterable[int]: ...

    def cut(self, texts: pd.Series, limit: int) -> Iterable[str]: ...


class PerWorker:
    """A model that is set up once in each Python worker: ``factory()`` gives the batch function."""

    def __init__(self, factory: Callable[[], Callable[[pd.Series], Iterable]]):
        self.factory = factory
        self._model = None

    def __call__(self, texts: pd.Series) -> Iterable:
        if self._model is None:
            self._model = self.factory()
        return self._model(texts)

    def __getstate__(self) -> dict:
        return {"factory": self.factory, "_model": None}


@dataclass(frozen=True)
class Models:
    embed: EmbedFn | None = None  # articles and clusters
    summarize: SummaryFn | None = None  # article text -> summary
    summarize_cluster: SummaryFn | None = None  # cluster text -> JSON with cluster_title and cluster_content
    window_tokens: int = WINDOW_TOKENS  # tokens of a cluster text that the models read at a time
    tokenizer: Tokenizer | None = None  # blank-separated words if there is none
