"""Tunables of the ingest and cluster runs."""

from __future__ import annotations

from dataclasses import dataclass

DAY_S = 86400


@dataclass(frozen=True)
class Params:
    max_articles: int = 5  # unseen entries taken per listing and run
    assign_threshold: float = 0.7  # similarity that joins an article to a cluster
    eps: float = 0.2  # cosine distance of two neighbours when new clusters form
    min_samples: int = 2
    article_lookback_s: int = DAY_S
    cluster_lookback_s: int = 7 * DAY_S
    embed_dim: int = 512
    max_tokens: int = 8000  # longest text handed to an article embedder that is passed in
    summary_min_tokens: int = 300  # texts up to this length get no summary
    summary_sentences: int = 5  # length of the built-in cluster summary, which is chosen from all members
    request_days: int = 7  # days a followed entry waits for its page
    dedup_days: int = 1  # days a URL stays in the ledger check
    # What a member without summary adds to the cluster text when an existing
    # cluster is refreshed: its title only, or title and paragraphs.
    update_text: str = "title_only"
    # Clusters whose vectors fit here are broadcast to the nearest-cluster join.
    broadcast_bytes: int = 64 << 20
    # Most rows of one vector block; bounds the memory of one join task.
    block_rows: int = 32768
    # Vectors joined with each other are put into neighbourhoods of pivots from so many on.
    index_rows: int = 16384
    # Most characters in one row of ``cluster_text``; models get their own windows of it instead.
    text_part_chars: int = 4 << 20
