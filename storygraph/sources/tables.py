"""The stored tables: append-only Parquet, one partition per batch, pruned by day.

Every run writes what it adds under its own batch number and reads only smaller
numbers. A batch that is run again therefore sees the same state and overwrites
its own files; nothing is applied twice, and no big table is ever rewritten.

    articles         day (of publication) / batch
    assignments      day (of publication) / batch   which article joined which cluster
    clusters         day (of update) / batch        newest row of a cluster counts
    cluster_members  day (of addition) / batch
    ledger           day / batch
    stats            batch                          deltas, summed when read
    requests         batch                          what a batch leaves waiting for its page
    open             batch                          what a cluster batch leaves as noise
    runs             batch                          time a batch stands for; finished ones in blocks of 1,000

The batches of a closed day can be folded into one folder (``fold``), of clusters only the newest
row of each; reads take it from there, with the same result, and ``drop_folded`` removes what it
replaces. So years of runs are a folder a day.

A read of the days since some time lists the folders of those days only, and what the last
finished batch left behind is read by its name, so a run costs the same however many batches
lie behind it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storygraph import schemas
from storygraph.functions.dates import utc_day
from storygraph.operators.clusters import MEMBER_KEY
from storygraph.params import DAY_S


BATCHES = 1000  # finished batches in one folder


class Store:
    """Tables below one folder on storage that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reading ---------------------------------------------------------------

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _folder(self, table: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, table: str) -> bool:
        files, path = self._folder(table)
        return files.exists(path)

    def _numbers(self, table: str, name: str) -> list[int]:
        """Values of the folders ``name=value`` right below a table, without a look into them."""
        files, path = self._folder(table)
        if not files.exists(path):
            return []
        found = [re.fullmatch(rf"{name}=(-?\d+)", one.getPath().getName()) for one in files.listStatus(path)]
        return [int(m[1]) for m in found if m]

    def _read(self, table: str, schema: T.StructType, before: int | None, since: int | None = None) -> DataFrame:
        """Rows of the batches before ``before``, and of the days from that of ``since`` (epoch) on."""
        parts = [T.StructField("day", T.LongType()), T.StructField("batch", T.LongType())]
        extra = [f for f in parts if f.name not in schema.fieldNames()]
        full = T.StructType(schema.fields + extra)
        root, first = self._path(table), None if since is None else since - since % DAY_S
        folded = {d: n for d, n in self._folded(table).items() if first is None or d >= first}
        if first is None and not folded:
            paths = [root] if self._exists(table) else []
        else:
            paths = [f"{root}/day={d}" for d in self._numbers(table, "day") if (first is None or d >= first) and d not in folded]
            # What a day got after it was folded.
            paths += [f"{root}/day={d}/batch={b}" for d, n in folded.items() for b in self._numbers(f"{table}/day={d}", "batch") if b > n]
        rows = self.spark.read.schema(full).option("basePath", root).parquet(*paths) if paths else self.spark.createDataFrame([], full)
        if folded:
            # A folded row keeps the number of its batch.
            kept = T.StructType(schema.fields + extra)
            names = [self._path(f"folded/{table}/day={d}/upto={n}") for d, n in folded.items()]
            rows = rows.unionByName(self.spark.read.schema(kept).parquet(*names).select(full.fieldNames()))
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _folded(self, table: str) -> dict[int, int]:
        """Folded days of a table, and the last batch in each."""
        out = {}
        for day in self._numbers(f"folded/{table}", "day"):
            done = [n for n in self._numbers(f"folded/{table}/day={day}", "upto") if self._exists(f"folded/{table}/day={day}/upto={n}/_SUCCESS")]
            if done:
                out[day] = max(done)
        return out

    def articles(self, before: int | None = None, since: int | None = None) -> DataFrame:
        """Articles with their cluster. ``since`` (epoch) prunes to publication days from then on."""
        rows = self._read("articles", schemas.ARTICLES, before, since)
        assigned = self._read("assignments", schemas.ASSIGNMENTS, before, since)
        new = assigned.select(*MEMBER_KEY, F.col("cluster_id").alias("_new"))
        return (
            rows.join(new, MEMBER_KEY, "left")
            .withColumn("cluster_id", F.coalesce("_new", "cluster_id"))
            .select(schemas.ARTICLES.fieldNames())
        )

    def pending_articles(self, batch: int, upto: int, since: int) -> DataFrame:
        """Articles stored up to ingest batch ``upto`` and not clustered before cluster batch ``batch``.

        Both tables are pruned to the publication days from ``since`` on.
        """
        rows = self.stored_articles(upto, since)
        taken = self._read("assignments", schemas.ASSIGNMENTS, batch, since)
        return rows.join(taken.select(MEMBER_KEY), MEMBER_KEY, "left_anti").select(schemas.ARTICLES.fieldNames())

    def stored_articles(self, upto: int, since: int) -> DataFrame:
        """Articles as stored up to ingest batch ``upto``, pruned to publication days from ``since`` on."""
        return self._read("articles", schemas.ARTICLES, upto + 1, since)

    def clusters(self, before: int | None = None, since: int | None = None) -> DataFrame:
        """Newest row of each cluster; ``since`` prunes to clusters updated from that time on."""
        rows = self._read("clusters", schemas.CLUSTERS, before, since)
        if since is not None:
            rows = rows.filter(F.col("last_updated") >= since)
        newest = rows.groupBy("cluster_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["cluster_id", "batch"], "left_semi").select(schemas.CLUSTERS.fieldNames())

    def members(self, before: int | None = None, since: int | None = None) -> DataFrame:
        """Memberships; ``since`` prunes to those added from that day on."""
        rows = self._read("cluster_members", schemas.CLUSTER_MEMBERS, before, since)
        return rows.select(schemas.CLUSTER_MEMBERS.fieldNames())

    def ledger(self, before: int | None = None, since: int | None = None) -> DataFrame:
        return self._read("ledger", schemas.LEDGER, before, since).select(schemas.LEDGER.fieldNames())

    def _left_by(self, table: str, kind: str, schema: T.StructType, before: int) -> tuple[DataFrame, int]:
        """What the last finished batch before ``before`` left, and its number; only its folder is opened."""
        batch = self.last_finished(kind, before)
        name = f"{table}/batch={batch}"
        if batch < 0 or not self._exists(name):
            return self.spark.createDataFrame([], schema), -1
        return self.spark.read.schema(schema).parquet(self._path(name)), batch

    def requests(self, before: int, since: int) -> DataFrame:
        """Requests from ``since`` on that the last batch before ``before`` left waiting; each batch carries on what still waits."""
        rows, _ = self._left_by("requests", "ingest", schemas.REQUESTS, before)
        return rows.filter(F.col("asked_at") >= since)

    def open_noise(self, before: int, settings: str) -> tuple[DataFrame | None, int]:
        """The noise of the last cluster batch before ``before`` and the time it stood for; none if it ran under other settings."""
        rows, batch = self._left_by("open", "cluster", schemas.OPEN, before)
        if batch < 0 or not rows.filter(F.col("settings") != settings).isEmpty():
            return None, 0
        return rows, self.open_run("cluster", batch, 0)[0]

    def stats(self, before: int | None = None) -> DataFrame:
        deltas = self._read("stats", schemas.STATS, before)
        return deltas.groupBy("source", "metric").agg(F.sum("value").alias("value"))

    # -- writing ---------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, batch: int, day: Column | None) -> None:
        parts = ["batch"] if day is None else ["day", "batch"]
        out = df.withColumn("batch", F.lit(batch).cast("bigint"))
        if day is not None:
            out = out.withColumn("day", day)
        if day is not None:
            # Few files per day, and a busy day still in several.
            out = out.hint("rebalance", "day")
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(self._path(table))
        )

    def add_articles(self, articles: DataFrame, batch: int) -> None:
        self._write(articles, "articles", batch, utc_day(F.col("article_published_date")))

    def add_assignments(self, assigned: DataFrame, batch: int) -> None:
        """``assigned``: source, article_id, cluster_id, article_published_date."""
        rows = assigned.select(*schemas.ASSIGNMENTS.fieldNames(), "article_published_date")
        self._write(rows, "assignments", batch, utc_day(F.col("article_published_date")))

    def add_clusters(self, clusters: DataFrame, batch: int) -> None:
        self._write(clusters.select(schemas.CLUSTERS.fieldNames()), "clusters", batch, utc_day(F.col("last_updated")))

    def add_members(self, members: DataFrame, batch: int) -> None:
        rows = members.select(schemas.CLUSTER_MEMBERS.fieldNames())
        self._write(rows, "cluster_members", batch, utc_day(F.col("added_at")))

    def add_ledger(self, rows: DataFrame, batch: int) -> None:
        self._write(rows.select("source", "category", "url", "day"), "ledger", batch, F.col("day"))

    def add_requests(self, waiting: DataFrame, batch: int) -> None:
        waiting.select(schemas.REQUESTS.fieldNames()).write.mode("overwrite").parquet(self._path(f"requests/batch={batch}"))

    def add_open_noise(self, noise: DataFrame, batch: int) -> None:
        noise.select(schemas.OPEN.fieldNames()).write.mode("overwrite").parquet(self._path(f"open/batch={batch}"))

    def add_stats(self, delta: DataFrame, batch: int) -> None:
        self._write(delta, "stats", batch, None)

    # -- upkeep ----------------------------------------------------------------

    def fold(self, table: str, closed_before: int, finished: int) -> list[int]:
        """Fold the days of ``table`` before that of ``closed_before`` (epoch), each into one folder; gives the days.

        Only batches up to ``finished``, the last that is known to be done, take part. A run in
        between reads either form: the folded one counts once it is written whole, and the
        batches stay until ``drop_folded``. Done again, a day is folded only if it got more.
        """
        schema = {"articles": schemas.ARTICLES, "assignments": schemas.ASSIGNMENTS, "clusters": schemas.CLUSTERS}
        schema |= {"cluster_members": schemas.CLUSTER_MEMBERS, "ledger": schemas.LEDGER}
        made = []
        for day in sorted(d for d in self._numbers(table, "day") if d < closed_before - closed_before % DAY_S):
            batches = [b for b in self._numbers(f"{table}/day={day}", "batch") if b <= finished]
            before = self._folded(table).get(day, -1)
            if not batches or max(batches) <= before:
                continue
            rows = self._read(table, schema[table], max(batches) + 1, day).filter(F.col("day") == day)
            if table == "clusters":
                newest = rows.groupBy("cluster_id").agg(F.max("batch").alias("batch"))
                rows = rows.join(newest, ["cluster_id", "batch"], "left_semi")
            rows.hint("rebalance").write.mode("overwrite").parquet(self._path(f"folded/{table}/day={day}/upto={max(batches)}"))
            made.append(day)
        return made

    def drop_folded(self, table: str) -> int:
        """Remove batches that a folded day holds, and older folds of a day; gives the number of folders.

        To be called when no run started before the fold is still at work.
        """
        gone = 0
        for day, upto in self._folded(table).items():
            names = [f"{table}/day={day}/batch={b}" for b in self._numbers(f"{table}/day={day}", "batch") if b <= upto]
            names += [f"folded/{table}/day={day}/upto={n}" for n in self._numbers(f"folded/{table}/day={day}", "upto") if n < upto]
            for name in names:
                files, path = self._folder(name)
                files.delete(path, True)
                gone += 1
        return gone

    # -- runs ------------------------------------------------------------------

    def _run_path(self, kind: str, batch: int) -> str:
        return f"runs/kind={kind}/batch={batch}"

    def open_run(self, kind: str, batch: int, now: int) -> tuple[int, int]:
        """(time, last finished ingest batch) that a batch stands for.

        Fixed on the first try; a replay gets the same again.
        """
        name = self._run_path(kind, batch)
        if self._exists(f"{name}/_SUCCESS"):
            row = self.spark.read.schema("as_of bigint, upto bigint").parquet(self._path(name)).first()
            return row.as_of, row.upto
        upto = self.last_finished("ingest")
        first = self.spark.createDataFrame([(now, upto)], "as_of bigint, upto bigint")
        first.coalesce(1).write.mode("overwrite").parquet(self._path(name))
        return now, upto

    def close_run(self, kind: str, batch: int) -> None:
        done = self.spark.createDataFrame([(batch,)], "number bigint")
        done.coalesce(1).write.mode("overwrite").parquet(self._path(f"runs/kind={kind}_done/block={batch // BATCHES}/batch={batch}"))

    def last_finished(self, kind: str, before: int | None = None) -> int:
        """The largest number among the finished batches (before ``before``), -1 if there is none; only names are read."""
        root = f"runs/kind={kind}_done"
        for block in sorted(self._numbers(root, "block"), reverse=True):
            if before is not None and block > (before - 1) // BATCHES:
                continue
            for batch in sorted(self._numbers(f"{root}/block={block}", "batch"), reverse=True):
                if (before is None or batch < before) and self._exists(f"{root}/block={block}/batch={batch}/_SUCCESS"):
                    return batch
        return -1
