"""The queries of this folder and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    divergence,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    neighbours,
    oracles,
    periodic_runs,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op9_warc": oracles.WARC,
    "op10_line_dedup": oracles.LINE_DEDUP,
    "op11_periodic_runs": oracles.PERIODIC_RUNS,
    "op12_source_divergence": oracles.DIVERGENCE,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, threshold=80)


@query
def op2_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(4, 2)
    found = language_id.identify(docs, docs.filter(~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_decontamination(spark, sf_dir):
    return decontamination.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


@query
def op1_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_warc(spark, sf_dir):
    records = warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_toxicity(spark, sf_dir):
    docs, out = _table(spark, sf_dir, "documents").select("doc_id", "text"), language_id.held_out(3, 1)
    model = toxicity.fit(toxicity.labelled(docs.filter(~out), _table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_lm_scoring(spark, sf_dir):
    docs, out = _table(spark, sf_dir, "documents").select("doc_id", "text"), language_id.held_out(5, 1)
    found = lm_scoring.score(docs, docs.filter(~out))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op11_periodic_runs(spark, sf_dir):
    docs = periodic_runs.planted(_table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs, min_length=6, min_exponent=4))


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


@query
def op13_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, bits=3)
