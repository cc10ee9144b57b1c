"""The registered queries of the operators in this package, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import (
    fingerprints,
    hard_negatives,
    html_extract,
    packing,
    sentencepiece_search,
    simhash,
    spelling,
    suffix_dedup,
    token_files,
    topk,
    toxicity,
    url_filters,
    warc,
)
from concordat.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; TOKENIZERS_DIR names another folder."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def learnable():
    """Labels that may be learned from: those of documents that are not held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.train(documents, read(spark, sf_dir, "labels"), learnable())
    scored = toxicity.with_score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), window=100).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_neighbours(read(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_search.checked(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query(
    "op8_topk",
    """
    WITH usable AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.r, q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.linked(warc.derived(warc.responses(read(spark, sf_dir, "pages"))))


@query("op10_html")
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.train(pages))


URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]


@query(
    "op12_url_filters",
    """
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut
    ), rules (verdict, rule_host, rule_path) AS (
        VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
    ), numbered AS (
        SELECT row_number() OVER () AS r, * FROM parts
    ), fit AS (
        SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY r
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fit USING (r)
    """,
)
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), least=6, often=5, ratio=5, slips=199)


@query(
    "op13_hard_negatives",
    """
    WITH usable AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS MATERIALIZED (
        SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
               CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
        FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND a.r <> c.r AND len(a.v) = len(c.v)
    ), positives AS (
        SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS p
        FROM scored WHERE alike QUALIFY p <= 5
    ), negatives AS (
        SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY r, p ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM positives JOIN scored s USING (r, anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    embeddings = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(embeddings, F.col("vec_id") % 50 == 0, positives=5, negatives=3, window=(50, 95, 100))
