"""Benchmark decontamination: every passage queries a BM25 index of test items (block-max pruning), hits are verified.

A text is cut into overlapping passages long enough to hold any item whole. Scores are BM25 of the passage's
distinct words against an item, as a share of what the whole item would score, so one threshold fits all items.
Pruning is exact: a passage is skipped if the sum of its words' greatest contributions to any item stays below the
threshold, then every block of items whose block maxima do; only what is left is scored. Hits count if the
passage holds enough word n-grams of the item's question and of its answer.

Document frequencies, the number of items and their mean length are Spark aggregates over all items. Items are dealt
to shards by a hash; a task builds each shard's index and writes it to the shared folder, and documents pass one shard
at a time, so neither the driver nor a worker holds more than one. Items of a shard have one index per class of length.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findmill.llm.common import combine, materialise, small_batches, word_hashes, words_of_texts

# BM25's constants.
K1, B = 1.2, 0.75
#: Items per block of the index; bytes of item texts of a shard, on average; least words of a passage's half.
BLOCK, INDEX_BYTES, HALF = 4, 4 << 20, 64
#: Cells of the table of block bounds that is held at a time.
DENSE = 1 << 20
#: Share of an item's own score, and of the n-grams of its question and its answer, that make a hit.
THRESHOLD, OVERLAP, NGRAM = 0.6, 0.6, 3

_PLAIN = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in bytes(range(256)).lower())
_ANSWER = re.compile(r"(?s)^(.*[.!?:\n])\s*(\S.*?)$")

LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.LongType()),
]))


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words in lower case without ASCII punctuation."""
    return word_hashes(text.translate(_PLAIN))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: what stands before the last sentence, and the last sentence; one sentence is both."""
    m = _ANSWER.match(text.strip())
    return (m[1], m[2]) if m and m[1].strip() else (text, text)


def _grams(text: str) -> np.ndarray:
    words = words_of(text.encode())
    return np.unique(combine(words, min(NGRAM, max(1, len(words)))))


class ItemIndex:
    """Inverted index of items with contributions as shares of each item's own score.

    ``df``, ``n`` and ``mean`` are of all items; without them these items are all.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int] | None = None, n: int | None = None, mean: float | None = None) -> None:
        # items of like length share a block: their words weigh alike, so block maxima are tight
        kept = sorted((len(words_of(t.encode())), i, t) for i, t in items)
        kept = [(i, t) for n, i, t in kept if n]
        counts = [Counter(words_of(t.encode()).tolist()) for _, t in kept]
        lengths = np.array([sum(c.values()) for c in counts])
        self.ids = [i for i, _ in kept]
        self.half = max(HALF, int(lengths.max(initial=0)))
        self.parts = [tuple(_grams(p) for p in split_item(t)) for _, t in kept]
        self.sizes = [tuple(min(NGRAM, max(1, len(words_of(p.encode())))) for p in split_item(t)) for _, t in kept]
        own_df = Counter(w for c in counts for w in c)
        df, n = df or own_df, n or len(kept)
        mean = mean or (lengths.mean() if len(lengths) else 1.0)
        self.terms = np.array(sorted(own_df), dtype=np.uint64)
        where = {t: k for k, t in enumerate(self.terms.tolist())}
        idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in self.terms.tolist()])
        postings: list[list[tuple[int, float]]] = [[] for _ in where]
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * lengths[k] / mean)
            part = {where[t]: idf[where[t]] * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(part.values())
            for t, v in part.items():
                postings[t].append((k, v / own))
        self.start = np.concatenate(([0], np.cumsum([len(p) for p in postings]))).astype(np.int64)
        self.item = np.array([k for p in postings for k, _ in p], dtype=np.int64)
        self.part = np.array([v for p in postings for _, v in p])
        self.most = np.maximum.reduceat(self.part, self.start[:-1]) if len(self.part) else np.empty(0)
        # postings are in item order, so the entries of a block stand together: one maximum per term and block
        new = np.flatnonzero(np.diff(self.item // BLOCK, prepend=-1) | np.isin(np.arange(len(self.item)), self.start[:-1]))
        self.block = self.item[new] // BLOCK
        self.block_most = np.maximum.reduceat(self.part, new) if len(new) else np.empty(0)
        self.block_start = np.searchsorted(new, self.start)
        # a bit per leading hash bits tells most words apart from the items' words at once
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def _terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the words that the index has."""
        at = np.flatnonzero(self.sieve[(words >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        hit = self.terms[k] == words[at]
        return at[hit], k[hit]

    def _entries(self, start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all terms, and for each the place of its term in ``terms``."""
        sizes = start[terms + 1] - start[terms]
        own = np.repeat(np.arange(len(terms)), sizes)
        return np.arange(len(own)) + np.repeat(start[terms] - np.cumsum(sizes) + sizes, sizes), own

    def _alive(self, half: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima reach the threshold; ``half``, ``term``: distinct, by half."""
        blocks = int(self.block.max()) + 1
        step = max(1, min(n, DENSE // blocks))
        passages, alive = [], []
        for first in range(0, n, step):
            a, b = np.searchsorted(half, (first, first + step + 1))
            entry, own = self._entries(self.block_start, term[a:b])
            key = (half[a:b][own] - first) * blocks + self.block[entry]
            bound = np.bincount(key, weights=self.block_most[entry], minlength=(step + 1) * blocks).reshape(-1, blocks)
            p, k = np.nonzero(bound[:-1] + bound[1:] >= threshold)
            passages.append(p + first)
            alive.append(k)
        return np.concatenate(passages), np.concatenate(alive)

    def _score(self, terms: np.ndarray, threshold: float, alive: np.ndarray | None = None) -> list[tuple[int, float]]:
        """Items (of the blocks ``alive``) at or above the threshold for a set of terms."""
        entry, _ = self._entries(self.start, terms)
        if alive is not None:
            entry = entry[np.isin(self.item[entry] // BLOCK, alive)]
        total = np.bincount(self.item[entry], weights=self.part[entry])
        return [(int(k), float(total[k])) for k in np.flatnonzero(total >= threshold)]

    def leaks(self, words: np.ndarray, threshold: float, overlap: float) -> list[dict]:
        """One entry per item that a text (its words' hashes) holds: its best passage."""
        if not len(self.terms):
            return []
        at, term = self._terms(words)
        if not len(at):
            return []
        threshold -= 1e-9
        n = len(words) // self.half + 1
        bound = np.bincount(at // self.half, weights=self.most[term], minlength=n + 1)
        if (bound[:n] + bound[1:n + 1]).max() < threshold:
            return []
        half, term = np.divmod(np.unique(at // self.half * len(self.terms) + term), len(self.terms))
        passages, alive = self._alive(half, term, n, threshold)
        edges = np.searchsorted(half, np.arange(n + 2))
        best: dict[int, dict] = {}
        for p in np.unique(passages).tolist():
            found = np.unique(term[edges[p]:edges[p + 2]])
            passage = None
            for k, score in self._score(found, threshold, alive[passages == p]):
                passage = words[p * self.half:(p + 2) * self.half] if passage is None else passage
                shares = []
                for grams, size in zip(self.parts[k], self.sizes[k], strict=True):
                    shares.append(float(np.isin(grams, combine(passage, size)).mean()) if len(grams) else 1.0)
                if min(shares) >= overlap and (k not in best or score > best[k]["exact"]):
                    best[k] = {"item_id": self.ids[k], "score": round(score, 6), "question_overlap": shares[0], "answer_overlap": shares[1], "first_word": p * self.half, "exact": score}
        out = sorted(best.values(), key=lambda x: x["item_id"])
        for x in out:
            del x["exact"]
        return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _hashed_words(texts: pd.Series) -> pd.Series:
    return pd.Series([words_of(bytes(t)).view(np.int64) for t in texts], dtype=object)


def _length_class(n_words: int) -> int:
    """0 up to ``HALF`` words, then one class per doubling: one long item doesn't widen the passages of short ones."""
    return max(0, (n_words - 1) // HALF).bit_length()


def item_indexes(items: DataFrame) -> tuple[DataFrame, int]:
    """(shard, index) of (item_id, text), written; and the number of shards, of ``INDEX_BYTES`` of text on average."""
    texts = items.select(F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text")).distinct()
    rows = materialise(texts.withColumn("words", _hashed_words(F.col("text").cast("binary"))).filter(F.size("words") > 0), "items")
    n, mean, n_bytes = rows.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.octet_length("text"))).first()
    n_shards = max(1, -(-(n_bytes or 0) // INDEX_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)).cast("int"))
    held = dealt.select("shard", F.explode(F.array_distinct("words")).alias("term")).groupBy("shard", "term").agg(F.count("*").alias("n"))
    total = held.groupBy("term").agg(F.sum("n").alias("df"))

    def build(of_shard: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        df = dict(zip(terms["term"].to_numpy().view(np.uint64).tolist(), terms["df"].tolist(), strict=True))
        classes = defaultdict(list)
        for item, text, words in zip(of_shard["item_id"], of_shard["text"], of_shard["words"], strict=True):
            classes[_length_class(len(words))].append((int(item), text))
        indexes = [ItemIndex(classes[c], df, n, mean) for c in sorted(classes)]
        return pd.DataFrame({"shard": of_shard["shard"].iloc[:1].to_numpy(), "index": [pickle.dumps(indexes)]})

    terms = held.join(total, "term").select(F.col("shard").alias("of"), "term", "df")
    built = dealt.groupBy("shard").cogroup(terms.groupBy("of")).applyInPandas(build, "shard int, index binary")
    return materialise(built, "item-index"), n_shards


def _shards(items: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """Each shard's indexes in turn, and whether it is the last; the one before leaves the executors first."""
    table, n = item_indexes(items)
    for k in range(n):
        row = table.filter(F.col("shard") == k).select("index").first()
        yield items.sparkSession.sparkContext.broadcast(pickle.loads(row[0]) if row else []), k == n - 1


def _leaks(text: Column, shard: Broadcast, threshold: float, overlap: float) -> Column:
    """The items of a shard that a text (bytes, in lower case) holds: item_id, score, question_overlap, answer_overlap, first_word of the best passage."""

    @F.pandas_udf(LEAKS)
    def find(texts: pd.Series) -> pd.Series:
        held = shard.value
        flat, counts = words_of_texts([bytes(t).translate(_PLAIN) for t in texts])
        words = np.split(flat, np.cumsum(counts)[:-1])
        return pd.Series([[x for i in held for x in i.leaks(w, threshold, overlap)] for w in words], dtype=object)

    return find(text)


def _lowered() -> Column:
    """The text in lower case, also beyond ASCII."""
    return F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of every leak in ``docs`` (doc_id, text).

    Repeated rows are searched each for itself; empty tables on either side give no rows; other columns are ignored.
    Items without words match nothing; one without an id is item -1; a null or empty text holds none; items with equal
    texts are all named. A long text is searched whole, a passage at a time.
    """
    small_batches(docs.sparkSession)
    found = None
    for shard, last in _shards(items):
        leaks = docs.select("doc_id", F.inline(_leaks(_lowered(), shard, threshold, overlap)))
        if found is not None or not last:
            leaks = materialise(leaks, "leaks")
            shard.unpersist()
        found = leaks if found is None else found.union(leaks)
    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item; repeated rows stay or go together."""
    small_batches(docs.sparkSession)
    for shard, last in _shards(items):
        docs = docs.filter(F.size(_leaks(_lowered(), shard, threshold, overlap)) == 0)
        if not last:
            docs = materialise(docs, "clean-of-shard")
            shard.unpersist()
    return docs
