"""Packing of token sequences into windows of fixed capacity (minimum bin slack).

Per bin, the longest piece left is placed, and a bitset subset-sum over the lengths available finds the fullest
feasible combination to go with it; the combination is removed. Only the number of pieces per length matters, and
there are at most ``limit`` lengths whatever the size of the corpus, so the combinations are found once from that
histogram, each for as many bins as it can fill. Pieces then find their place by their rank among the pieces of
equal length. Ranks come from counts per part of the written piece table; no length gathers in one task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findmill.llm.blocks import frame, with_id
from findmill.llm.common import small_batches, tidy, work_dir

PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, nth long"


class Encoder:
    """Token ids of texts as the tokenizer file gives them.

    ``ranks`` names a file with the same vocabulary for a faster library. It is used for texts within Latin-1,
    where the two libraries' character classes agree; all others go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None) -> None:
        self.path, self.ranks, self.pattern, self.special = path, ranks, pattern, special or {}
        self._slow = self._fast = None

    def __getstate__(self):
        return self.__dict__ | {"_slow": None, "_fast": None}

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            import os

            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self.ranks is None:
            return self.slow(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.slow(text)
        if self._fast is None:
            import base64

            import tiktoken

            with open(self.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=self.special)
        return self._fast.encode(text, allowed_special="all")


_ENCODERS: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, encoder: Encoder, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), part, nth of every document.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. A longer one than ``limit`` is
    cut into pieces of ``limit``, of which the first may be shorter. Rows without a doc_id are left out. Repeated rows are documents of their own, no
    rows give no pieces, other columns are ignored. The table is written once to the shared folder: ``nth`` counts
    pieces of one length within ``part``, and both must be the same for every later reader.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())])

    def cut(batches):
        own = _ENCODERS.setdefault(encoder.path, encoder)  # one vocabulary per worker process
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*own.encode(text.decode("utf-8", "replace")), end_id], dtype="<u4")
                edges = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append({"doc_id": doc, "piece": k, "start": a, "length": b - a, "ids": ids[a:b].tobytes(), "part": part, "nth": seen[b - a]})
                    seen[b - a] += 1
            yield frame(out, schema)

    path = work_dir(spark, "pieces")
    rows = with_id(docs)
    rows.mapInArrow(tidy(cut), PIECES).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(PIECES).parquet(path)


def fill_bins(counts: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and the number of bins that each fills; all pieces are used up."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        seed = next(iter(left))
        room = limit - seed
        mask, reach = (1 << (room + 1)) - 1, 1
        steps: list[tuple[int, int, int]] = []
        for n, c in left.items():
            many = min(c - (n == seed), room // n) if n <= room else 0
            times = 1
            while many > 0:
                use = min(times, many)
                steps.append((n, use, reach))
                reach |= (reach << (n * use)) & mask
                many -= use
                times *= 2
            if reach >> room:
                break  # a full bin
        full = reach.bit_length() - 1
        combination = defaultdict(int, {seed: 1})
        for n, use, before in reversed(steps):
            if not before >> full & 1:
                combination[n] += use
                full -= n * use
        bins = min(left[n] // m for n, m in combination.items())
        out.append((dict(combination), bins))
        for n, m in combination.items():
            left[n] -= m * bins
            if not left[n]:
                del left[n]
    return out


def _layout(combinations: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted by (length, first rank)."""
    rows, used, base = [], defaultdict(int), 0
    for combination, bins in combinations:
        at = 0
        for n, m in combination.items():
            rows.append((n, used[n], base, m, at))
            used[n] += m * bins
            at += n * m
        base += bins
    rows.sort()
    return dict(zip(("length", "rank", "base", "times", "at"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def place(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """``pieces`` (with length, part, nth; other columns stay) and their sequence_id and offset.

    Sequences hold at most ``limit`` tokens, offsets leave no gap from 0. No pieces give no rows.
    """
    by_length = pieces.groupBy("length").count().collect()  # at most ``limit`` rows
    layout = _layout(fill_bins({r["length"]: r["count"] for r in by_length}, limit))
    key = (layout["length"] << 48) | layout["rank"]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(key, (n << 48) | r, side="right") - 1
        bin_, slot = np.divmod(r - layout["rank"][k], layout["times"][k])
        return pd.DataFrame({"sequence_id": layout["base"][k] + bin_, "offset": layout["at"][k] + slot * n})

    in_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = in_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("where", find("length", F.col("nth") + F.col("before")))
    return ranked.select(*[pieces[c] for c in pieces.columns if c not in ("part", "nth")], "where.*")


def assemble(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (array of long) of each packed sequence; ``placed`` has ids."""
    gathered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # bounded by the capacity

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(bytes(x) for x in p), dtype="<u4").astype(np.int64) for p in parts], dtype=object)

    return gathered.select("sequence_id", joined("p.ids").alias("ids"))
