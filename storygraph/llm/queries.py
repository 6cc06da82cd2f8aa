"""Registered queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storygraph.llm.columns import word_count
from storygraph.llm.decontaminate import leaks
from storygraph.llm.exact_dedup import exact_duplicates
from storygraph.llm.hard_negatives import hard_negatives
from storygraph.llm.lexical_search import ranked_search
from storygraph.llm.lm_score import lm_scores
from storygraph.llm.mixing import with_copies
from storygraph.llm.near_dedup import near_duplicates
from storygraph.llm.pii import KINDS as PII_KINDS
from storygraph.llm.pii import sanitisation_spans
from storygraph.llm.quality import quality_scores
from storygraph.llm.secret_scan import KINDS as SECRET_KINDS
from storygraph.llm.secret_scan import scan_secrets
from storygraph.llm.sharding import assign_shards, number_slots
from storygraph.llm.token_files import read_token_files, write_token_files
from storygraph.llm.toxicity import toxicity_scores
from storygraph.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under a name; it gets a session with this package's settings."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        REGISTRY[name] = run
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "item_id", "similarity", "start", "shingles")


def listed(spans):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op2_pii")
def op2_pii(spark, sf_dir):
    found = sanitisation_spans(documents(spark, sf_dir))
    counts = [counted("spans", k) for k in PII_KINDS]
    base, terms = listed(F.col("spans")), listed(F.col("terms"))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"),
        F.size(F.filter("terms", lambda s: s["kind"] == "generalise")).cast("long").alias("n_generalised"),
        F.size(F.filter("terms", lambda s: s["kind"] == "remove")).cast("long").alias("n_removed"),
    )


@query("op4_lm_score")
def op4_lm_score(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir))


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    found = scan_secrets(documents(spark, sf_dir))
    plain = F.filter("findings", lambda f: f["layers"] == "")
    named = F.transform(
        "findings",
        lambda f: F.struct(
            F.when(f["layers"] == "", f["kind"]).otherwise(F.concat(f["kind"], F.lit("~"), f["layers"])).alias("kind"),
            f["start"].alias("start"),
            f["end"].alias("end"),
        ),
    )
    counts = [counted(plain, k) for k in SECRET_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(plain), 256).alias("base_sha256"),
        listed(named).alias("spans"),
        (F.size("findings") - F.size(plain)).cast("long").alias("n_nested"),
    )


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    slots = number_slots(assign_shards(rows, [1.0] * SHARDS))
    grown = assign_shards(slots, [1.0] * (SHARDS + 1), shard_col="grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op7_near_dedup")
def op7_near_dedup(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_exact_dedup")
def op9_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


@query("op10_mixing")
def op10_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    drawn = with_copies(docs.select("doc_id", "source", "text"), word_count(F.col("text")), [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))])
    return drawn.select(
        "doc_id",
        "mix.size",
        "mix.source_size",
        "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"),
    )


@query("op13_token_files")
def op13_token_files(spark, sf_dir):
    import public_tokenizers

    path = write_token_files(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_hard_negatives")
def op12_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op11_lexical_search")
def op11_lexical_search(spark, sf_dir):
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
