"""A training corpus from raw documents: toxic documents go, one document of each group of near
duplicates stays, repeated passages are cut, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.llm import packing, simhash, suffix_dedup, toxicity
from concordat.llm.common import read, work_folder, written
from concordat.llm.queries import learnable, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7, trained on the labels that may be learned from."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), learnable())
    return toxicity.with_score(docs.select(*COLUMNS), model).where("score < 0.7").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id.

    Null ids come last, and of rows that share an id the text with the smallest hash counts.
    Rows of the same id and text are near duplicates; the least by its other columns stays.
    They are reduced before the shuffle, so many copies of a row never meet in one task.
    """
    key = simhash.row_key()
    one = W.partitionBy(*key).orderBy("lang", "source", "n_chars")
    rows = docs.select(*COLUMNS, *[c.alias(n) for n, c in key.items()]).withColumn("nth", F.row_number().over(one))
    kept = simhash.survivors(docs, shingle=4, max_bits=4)
    return rows.where("nth = 1").join(kept, list(key), "left_semi").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes and more that also start earlier.

    Cuts fall between bytes; what is left of a character that was cut apart goes as well.
    Documents of which nothing is left stay, with an empty text.
    """
    cut = suffix_dedup.without_repeats(docs.select(*COLUMNS), window=100).drop("spans")
    at, schema = cut.columns.index("kept"), docs.select(*COLUMNS).schema

    def as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [k.decode("utf-8", "ignore") for k in b.column(at).to_pylist()]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for i, c in enumerate(COLUMNS)], names=COLUMNS)

    return cut.mapInArrow(as_text, schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed),
]

# Fingerprints, suffix order and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again by the next."""
    folder = work_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
