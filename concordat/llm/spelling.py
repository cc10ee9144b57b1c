"""Spelling variants: words one edit apart, found by walking a trie against itself.

The trie is a table of edges, one per distinct beginning of a word.  The frontier holds states
(word, node, edits): ``word`` is what has been read of a word and ``node`` the beginning of
another word it was read against; the position is the length of ``word``.  Words that begin
alike share their states until they part, so the root and other busy nodes have one state,
not one per word.  Each level joins the states with the edges on both sides by equality;
states of no edit open the three edits, states of one edit must agree from there on, and
states that end in two words make these neighbours.

Only one of each two mirrored states is followed.  An inserted character counts as the last of
its run, so every pair of words is reached in exactly one way and nothing is made distinct.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm import hashing
from concordat.llm.common import batch, pieces, work_folder, written
from concordat.operators.joins import keyed_join

LETTERS = "[a-zÀ-ÿ]"  # once A-Z are lower case
_RUN, _OTHER = re.compile(f"{LETTERS}+"), re.compile(f"[^{LETTERS[1:]}")
_SLICE = 1 << 20


def runs(text: str) -> Counter:
    """How often each maximal run of letters occurs; A-Z count as a-z, and no other letters change."""
    text = text.encode().lower().decode()  # bytes: only A-Z have a lower case
    found, at = Counter(), 0
    while at < len(text):
        edge = _OTHER.search(text, at + _SLICE)
        stop = edge.start() if edge else len(text)
        found.update(_RUN.findall(text, at, stop))
        at = stop
    return found


def with_slip(doc_id: int | None, run: str, every: int) -> str:
    """The run as its document has it: in one of ``every`` cases, by hash, without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(documents: DataFrame, least: int = 6, often: int = 5, slips: int | None = None, held: int = 1 << 17) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``often`` times or more.

    ``slips`` misspells one run of so many (see ``with_slip``), for corpora without slips of
    their own.  Tasks count up to ``held`` words at a time and pass sums on; null texts have no words, and
    a null id counts as an empty one.  Repeated rows count as often as they occur.
    """
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()
        for b in pieces(batches, 64):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for run, n in runs(text or "").items():
                    word = with_slip(doc_id, run, slips) if slips else run
                    if len(word) >= least:
                        sums[word] += n
                if len(sums) > held:
                    yield batch(out, list(sums), list(sums.values()))
                    sums = Counter()
        yield batch(out, list(sums), list(sums.values()))

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _edges(vocabulary: DataFrame, depth: int) -> DataFrame:
    """The trie's edges (depth, node, child, node_ends, child_ends), down to ``depth`` code points.

    ``child`` is a beginning of a word and ``node`` the same without its last code point; the
    flags say which of them are words themselves.
    """
    ends = F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(depth))))
    edges = (
        vocabulary.select("word", ends.alias("depth"))
        .select("depth", F.expr("substring(word, 1, depth)").alias("child"), (F.length("word") == F.col("depth")).alias("ends"))
        .groupBy("child").agg(F.first("depth").alias("depth"), F.bool_or("ends").alias("child_ends"))
        .withColumn("node", F.expr("substring(child, 1, depth - 1)"))
    )
    known = vocabulary.select(F.col("word").alias("node"), F.lit(True).alias("node_ends"))
    return edges.join(known, "node", "left").select(
        "depth", "node", "child", F.coalesce("node_ends", F.lit(False)).alias("node_ends"), "child_ends"
    )


def _added(edges: DataFrame) -> DataFrame:
    """States of one edit that begin with a code point more in ``node``."""
    return edges.select(F.col("node").alias("word"), F.col("child").alias("node"), F.col("node_ends").alias("word_ends"), F.col("child_ends").alias("node_ends"))


def _changed(edges: DataFrame) -> DataFrame:
    """States of one edit that begin with another code point in ``node``."""
    other = edges.select("node", F.col("child").alias("other"), F.col("child_ends").alias("other_ends"))
    return edges.join(other, "node").where("child < other").select(
        F.col("child").alias("word"), F.col("other").alias("node"), F.col("child_ends").alias("word_ends"), F.col("other_ends").alias("node_ends")
    )


def _moved(states: DataFrame, edges: DataFrame, below: DataFrame) -> DataFrame:
    """States of one edit after a code point that both sides share.

    The step that would repeat a code point just added is left out: it was added one later too.
    """
    read = edges.select(F.col("node").alias("word"), F.col("child").alias("next"), F.col("child_ends").alias("word_ends"))
    there = below.select(F.col("child").alias("to"), F.col("child_ends").alias("node_ends"))
    return (
        states.select("word", "node").join(read, "word").where("next <> node")
        .select(F.col("next").alias("word"), F.concat("node", F.expr("right(next, 1)")).alias("to"), "word_ends")
        .join(there, "to").select("word", F.col("to").alias("node"), "word_ends", "node_ends")
    )


_STATE = "word string, node string, word_ends boolean, node_ends boolean"


def neighbours(vocabulary: DataFrame, folder: str, depth: int = 40, per_task: int = 50_000) -> DataFrame:
    """(word, near): every two words of ``vocabulary`` (word) exactly one edit apart, both ways round.

    The walk has as many levels as the longest word has code points, at most ``depth``.  Two
    words that are both longer are found by ``_long_pairs``, in a fixed number of steps.
    ``vocabulary`` holds each word once; no words give no rows.
    """
    spark = vocabulary.sparkSession
    short = vocabulary.where(F.length("word") <= depth + 1).select("word")
    edges = _edges(short, depth + 1).repartitionByRange("depth", "node").sortWithinPartitions("depth", "node")
    edges = written(edges, folder, "edges")  # sorted by depth: a level reads little but its own
    counts = dict(edges.groupBy("depth").count().collect())  # at most depth + 1 rows
    states, levels = spark.createDataFrame([], _STATE), []
    for at in range(min(depth, max(counts, default=0)) + 1):
        # the states whose word part has ``at`` code points; nodes have as many or one more
        level, next_level = edges.where(F.col("depth") == at), edges.where(F.col("depth") == at + 1)
        found = _changed(level).union(_added(next_level))
        if levels:
            found = found.union(_moved(states, level, edges.where(F.col("depth").isin(at, at + 1))))
        tasks = -(-(counts.get(at, 0) + counts.get(at + 1, 0)) // per_task)
        states = written(found.coalesce(max(1, tasks)), folder, f"states-{at}")
        levels.append(f"{folder}/states-{at}")
    ended = spark.read.schema(_STATE).parquet(*levels).where("word_ends AND node_ends").select("word", "node")
    pairs = ended.union(_long_pairs(vocabulary.where(F.length("word") > depth).select("word"), folder))
    return pairs.select("word", F.col("node").alias("near")).union(pairs.select(F.col("node").alias("word"), F.col("word").alias("near")))


def _long_pairs(long_words: DataFrame, folder: str) -> DataFrame:
    """(word, node) one edit apart, each two once, by hashes of the words without one code point.

    Equal hashes make words candidates; the edit distance is then computed.  A hash of a place
    is shared by no more words than there are letters, so candidates stay as few as the pairs.
    """
    keyed = long_words.select(F.monotonically_increasing_id().alias("id"), "word")
    keyed = written(keyed, folder, "long")
    out = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("whole", pa.bool_())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = np.uint64(pow(hashing.BASES[0], -1, 1 << 64))
        for b in pieces(batches, 1):
            word = np.frombuffer(b.column(1)[0].as_py().encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            sums, n = hashing.prefix(word, hashing.BASES[0]), len(word)
            without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(hashing.BASES[1])
            key = np.concatenate([hashing.mixed(np.unique(without)), hashing.mixed(sums[-1:]), hashing.mixed(without ^ hashing.mixed(at))])
            whole = np.zeros(len(key), bool)
            whole[-n - 1 :] = True
            yield batch(out, key.view(np.int64), np.full(len(key), b.column(0)[0].as_py()), whole)

    # a word without one code point meets that whole word; two words without the same place meet each other
    found = keyed.mapInArrow(keys, "key long, id long, whole boolean")
    one, other = found.select("key", "id"), found.where("whole").select("key", F.col("id").alias("near"))
    candidates = one.join(other, "key").where("id <> near").select(F.least("id", "near").alias("id"), F.greatest("id", "near").alias("near")).distinct()
    second = keyed.select(F.col("id").alias("near"), F.col("word").alias("node"))
    return candidates.join(keyed, "id").join(second, "near").where(F.levenshtein("word", "node", 1) == 1).select("word", "node")


def variants(documents: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, slips: int | None = None, depth: int = 40) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all documents, grouped by spelling.

    ``n_near`` counts the words one edit away.  The one of them that occurs most (ties: the
    smallest in code-point order) is the word's form if it occurs at least ``ratio`` times as
    often as the word; otherwise ``form`` and ``form_n`` are null.  ``root`` is where the forms
    lead in the end, the word itself if it has none.  See ``words`` for what counts as a word
    and for null texts; an empty table and one without frequent words give no rows.  Columns
    other than doc_id and text are not read.
    """
    folder = work_folder(documents.sparkSession)
    vocabulary = written(words(documents, least, often, slips), folder, "words")
    pairs = neighbours(vocabulary.select("word"), folder, depth)
    counts = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    common = -F.col("best.less") >= ratio * F.col("n")
    formed = written(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
        ),
        folder, "forms",
    )
    # every form occurs at least ``ratio`` times as often, so few doublings reach all roots
    roots, at = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = keyed_join(roots, ahead, ["root"], "left")
        roots = written(further.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")), folder, f"roots-{at}")
        if not roots.where("went").limit(1).count():
            break
        roots, at = roots.select("word", "root"), at + 1
    return formed.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
