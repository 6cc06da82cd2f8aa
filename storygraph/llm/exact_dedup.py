"""Exact duplicates by a tree merge of sorted digest runs.

Every document falls into one of ``runs`` runs by a hash of its id and digest; a run holds each
digest once, with the identifier to keep and the number of copies. Partitions exchange runs in
rounds along a binomial tree: in each one neighbouring runs meet, slice by slice of the
digest space, and are merged in the order of their digests. Entries count as equal only if digest, length and a second hash agree,
which every level verifies again; the smallest identifier stays. A digest that a third of
all rows share is one entry of a run, so few of a merge. The answer goes back down to the
first runs and from there to the documents, by digests, never by texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storygraph.session import materialize

SLICE_DIGITS = 3
FAN_IN = 8
# What two entries have to agree on to be one: SHA-256, length and a second hash.
SAME = ["slice", "digest", "n_bytes", "second"]


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    runs: int = 64,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names which id of equal texts stays, ``smallest`` or ``largest``. A null text
    counts as empty. Rows repeated under one id count as that many copies and one of them is
    kept. A null id is kept only where its whole group has null ids. Other columns of
    ``docs`` play no part. An empty table gives an empty result. ``fan_in`` runs meet in a
    round: with 2 the tree is the binomial one, with more several of its rounds are one.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    first_kept = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    text = F.coalesce(docs[text_col], F.lit(""))
    sha = F.sha2(text, 256)
    rows = docs.select(
        docs[id_col].alias("id"),
        F.conv(F.substring(sha, 1, SLICE_DIGITS), 16, 10).cast("int").alias("slice"),
        F.unhex(sha).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("second"),
    )
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id", "digest"), F.lit(runs)).cast("int"))
    entries, _ = materialize(rows.groupBy("run", *SAME, "id").agg(F.count(F.lit(1)).alias("copies")))

    # One entry per digest and run, combined before it leaves a task, so no merge holds a group of copies.
    first, _ = materialize(entries.groupBy("run", *SAME).agg(best("id").alias("keep_id"), F.sum("copies").alias("n")))
    level, width = first, runs
    while width > 1:
        width = -(-width // fan_in)
        level = merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), first_kept)

    root = level.select(*SAME, "keep_id", F.col("n").alias("group_size"))
    answers = first.select("run", *SAME).join(root, SAME)
    out = entries.join(answers, ["run", *SAME])
    # Ids are unique as a rule; where a row is repeated, its copies become rows again here.
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000)))
    out = out.select("id", "keep_id", "group_size", "digest", "copies", thousands.alias("thousand"))
    last = F.least(F.col("copies"), (F.col("thousand") + 1) * 1000)
    copy = F.explode(F.sequence(F.col("thousand") * 1000 + 1, last))
    return out.select("id", "keep_id", "group_size", "digest", copy.alias("copy")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def merged(runs: DataFrame, first_kept: Column) -> DataFrame:
    """Runs of equal number as one sorted run: of each digest one entry, with its verified identifier.

    Sorted runs that meet in a task are merged by its sort, and the merge is read in order: the
    first of equal entries stays and carries the copies of all. A task holds one digest at a time.
    """
    dealt = runs.repartition("run", "slice").sortWithinPartitions("run", *SAME, first_kept)
    equal = Window.partitionBy("run", *SAME).orderBy(first_kept)
    everyone = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = dealt.withColumn("nth", F.row_number().over(equal)).withColumn("n", F.sum("n").over(everyone))
    return ranked.filter(F.col("nth") == 1).drop("nth")
