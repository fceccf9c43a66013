"""Importance resampling of documents toward a target: bucketed word runs, gains per bucket, and a keyed draw.

Words come from the ``tokenizers`` library: an untrained split by a regular expression over text in ASCII lower case
gives words with their offsets, and windows over pairs of offsets give runs of words. A run's bucket is the CRC of
its bytes. Two histograms, of the documents and of the target, give each bucket a gain; a document's weight is the
sum over its runs. The draw adds noise that depends on the document's id alone, so that it is the same whenever the
job runs. Texts are read once: what later steps need of them is their buckets, two bytes a run, in a work table.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import materialise, small_batches, tidy

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of a histogram (two bytes tell one), words of the longest run, least words of a document to be drawn, share drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Runs whose buckets a worker remembers at a time.
KNOWN = 1 << 18

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])


def splitter():
    """The untrained splitter: what matches ``WORD`` stays, the rest goes."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), behavior="removed", invert=True)


def windows(words: list[str], longest: int) -> list[str]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats included.

    The words are joined once; a run is then the window from its first word's start to its last word's end.
    """
    if longest == 1:
        return words
    text = " ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [text[starts[i]:ends[i + n - 1] - 1] for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


class _Buckets(dict):
    """Bucket of a run; starts anew when full."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, run: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = zlib.crc32(run.encode()) % self.n
        if len(run) <= 64:
            self[run] = found
        return found


def bucketed(docs: DataFrame, column: str, n_buckets: int, longest: int, name: str) -> DataFrame:
    """Work table (doc_id, n_words, n_features, buckets): each text's runs as compressed 16-bit bucket numbers."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("buckets are told by two bytes")

    def measure(batches):
        split, known, press = splitter(), _Buckets(n_buckets), zstandard.ZstdCompressor(1)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = [w for w, _ in split.pre_tokenize_str(text.lower().decode())]
                found = windows(words, longest)
                out.append((len(words), len(found), press.compress(np.fromiter(map(known.__getitem__, found), dtype="<u2", count=len(found)).tobytes())))
            n_words, n_features, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(data, pa.binary())], schema=FEATURES)

    small_batches(docs.sparkSession)
    # the text as bytes: their lower() changes A-Z only
    rows = docs.select(F.col(column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return materialise(rows.mapInArrow(tidy(measure), "doc_id long, n_words long, n_features long, buckets binary"), name)


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data, max_output_size=max(1, 2 * n)), dtype="<u2")


def histogram(features: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, n) over all runs; each task sends a row per bucket at most."""

    def count(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for n, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                total += np.bincount(_numbers(data, n), minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return features.select("n_features", "buckets").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket that either histogram holds: thousandths of the log ratio of smoothed shares."""
    both = materialise(docs.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]), "gain-buckets")
    every, wanted = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = (F.col("t") + 1) * F.lit(every + n_buckets) / ((F.col("s") + 1) * F.lit(wanted + n_buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def importance_weights(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of ``docs`` (doc_id, text), toward ``target`` (text).

    A null or empty text has no words, no features and weight 0. Repeated rows are counted and weighed each for
    itself; a null doc_id stays. No documents give no rows; an empty target is a flat one. Other columns are ignored.
    """
    features = bucketed(docs, "doc_id", n_buckets, longest, "importance-documents")
    aims = bucketed(target.select(F.lit(None).alias("doc_id"), "text"), "doc_id", n_buckets, longest, "importance-target")
    table = np.zeros(n_buckets, dtype=np.int64)
    # at most ``n_buckets`` rows
    for bucket, gain in gains(histogram(features, n_buckets), histogram(aims, n_buckets), n_buckets).collect():
        table[bucket] = gain

    def weigh(batches):
        for batch in batches:
            weight = [int(table[_numbers(data, n)].sum()) for n, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(tidy(weigh), "doc_id long, n_words long, n_features long, weight long")


def draw(weights: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``weights`` with score (weight and keyed noise) and rank among the drawn; undrawn rows have a null rank.

    Of the N rows with ``least_words`` words, floor(percent * N / 100) highest scores are drawn, ties to the smaller
    doc_id. A null doc_id gets the noise of the empty string and comes last among ties; repeated rows follow one
    another in any order. Ranks are places in ranges of scores that tasks sort side by side, so no task meets all rows.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = materialise(weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share)))).withColumn("row", F.monotonically_increasing_id()), "importance-scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    may = F.col("n_words") >= least_words
    # the id counts the rows of a task from 0 below its 33rd bit, tasks are ranges in order
    placed = materialise(scored.filter(may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-ranked")
    part, size = F.shiftright("at", 33), 0
    before = []
    for number, n in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row per task
        before.append((number, size))
        size += n
    offsets = weights.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= percent * size // 100, rank))
    kept = [*weights.columns, "score"]
    return drawn.select(*kept, "rank").unionByName(scored.filter(~may).select(*kept, F.lit(None).cast("long").alias("rank")))
