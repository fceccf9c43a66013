"""Ranked lexical search with pair bounds: the k best documents of every item, exactly.

Documents are indexed in blocks. A block holds the postings of the items' terms with their impacts (what a term adds to
a document's score), each term's greatest impact, and lists for pairs of terms that stand next to each other in an item's
order of weights: where both occur, and the greatest impact the two have together in one document. Terms that avoid
each other add far less together than their two maxima, so a chain of pairs bounds the light terms of an item more
tightly than the sum of the maxima. With the score that the k-th best document has so far, such bounds skip whole blocks,
then the documents that hold light terms only, then candidates one term at a time. Skipping never loses a document:
only what cannot reach the k-th score is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmill.llm.common import blank, materialise, small_batches, tidy

#: Documents returned for an item.
TOP = 10
#: Text bytes and documents of a block (a longer text is a block of its own), and item bytes searched at a time.
BLOCK_BYTES, BLOCK_DOCS, SHARD_BYTES = 4 << 20, 2_048, 4 << 20
#: How far apart in an item's order two terms of a pair may stand, and pairs intersected at a time.
REACH, PAIRS_AT_ONCE = 3, 512

_LAST = np.iinfo(np.int64).max
_PLAIN = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in bytes(range(128)).lower() + bytes(range(128, 256)))

POSTINGS = "doc_ids binary, n_words binary, terms binary, starts binary, docs binary, tf binary, with_terms long, words long, term array<int>, df array<long>"
INDEX = "doc_ids binary, terms binary, starts binary, docs binary, impacts binary, most binary, pairs binary, joint binary"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; all beyond ASCII counts as letters."""
    return text.translate(_PLAIN).split()


def _array(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def shards(items: DataFrame, level: int = 0) -> Iterator[DataFrame]:
    """Items (item_id, text) in shards of at most ``SHARD_BYTES`` of text, or of one item_id that has more."""
    size, ids = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_distinct(F.coalesce("item_id", F.lit(-1)))).first()
    if size <= SHARD_BYTES or ids <= 1:
        yield items
        return
    n = max(2, -(-size // SHARD_BYTES))
    for k in range(n):
        yield from shards(items.filter(F.pmod(F.xxhash64("item_id", F.lit(level)), F.lit(n)) == k), level + 1)


class Items:
    """The items of a shard: their terms by number, and after weighing the order and the pairs of each."""

    def __init__(self, rows: list[tuple[int, str]], reach: int | None = None) -> None:
        self.reach = reach or REACH
        held = defaultdict(set)
        for item, text in rows:
            held[item].update(terms_of(text.encode()))
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*held.values())))}
        self.ids = list(held)
        self.terms = [np.array(sorted(map(self.vocabulary.__getitem__, t)), dtype=np.int64) for t in held.values()]

    def weigh(self, weight: np.ndarray) -> None:
        """Light terms first; pairs are terms at most ``reach`` apart in that order."""
        self.weight = weight
        self.terms = [t[np.lexsort((t, weight[t]))] for t in self.terms]
        n = len(self.vocabulary)
        keys = [t[:-d] * n + t[d:] for t in self.terms for d in range(1, self.reach + 1) if len(t) > d]
        self.pairs = np.unique(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], name: str) -> DataFrame:
    """Work table with a row per block: postings of the known terms, and the block's share of the corpus counts."""
    schema = pa.schema([*[(c, pa.binary()) for c in ("doc_ids", "n_words", "terms", "starts", "docs", "tf")], ("with_terms", pa.int64()), ("words", pa.int64()), ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])

    def block(ids: list[int | None], sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        key, tf = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *found]) * len(ids) + owner, return_counts=True)
        term, doc = np.divmod(key, max(1, len(ids)))
        terms, starts, df = np.unique(term, return_index=True, return_counts=True)
        row = {
            "doc_ids": np.array([_LAST if i is None else i for i in ids], dtype="<i8").tobytes(), "n_words": np.array(sizes, dtype="<i8").tobytes(),
            "terms": terms.astype("<i4").tobytes(), "starts": np.append(starts, len(key)).astype("<i8").tobytes(), "docs": doc.astype("<u4").tobytes(), "tf": tf.astype("<u4").tobytes(),
            "with_terms": int(np.count_nonzero(sizes)), "words": int(sum(sizes)), "term": terms.astype(np.int32), "df": df,
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def work(batches):
        ids, sizes, found, size = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (size + len(text) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield block(ids, sizes, found)
                    ids, sizes, found, size = [], [], [], 0
                words = terms_of(text)
                ids.append(doc)
                sizes.append(len(words))
                found.append(np.fromiter((vocabulary[w] for w in words if w in vocabulary), dtype=np.int64))
                size += len(text)
        if ids:
            yield block(ids, sizes, found)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text"))
    return materialise(rows.mapInArrow(tidy(work), POSTINGS), name)


def term_weights(blocks: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, documents with terms, and their terms with repeats."""
    n, length = blocks.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    each = blocks.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1)))
    out = np.zeros(n_terms, dtype=np.int64)
    # a row per known term at most
    for term, w in each.select("term", weight).collect():
        out[term] = w
    return out, n, length


def joint_impacts(terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, pairs: np.ndarray, n_terms: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose terms a block holds both, and the greatest impact of both in one document (0 where they never meet)."""
    a, b = np.divmod(pairs, max(1, n_terms))
    at = np.full(n_terms, -1)
    at[terms] = np.arange(len(terms))
    here = np.flatnonzero((at[a] >= 0) & (at[b] >= 0))
    joint = np.zeros(len(here), dtype=np.int64)
    for first in range(0, len(here), PAIRS_AT_ONCE):
        some = here[first:first + PAIRS_AT_ONCE]
        rows, place = np.unique(np.concatenate((at[a[some]], at[b[some]])), return_inverse=True)
        sizes = starts[rows + 1] - starts[rows]
        entry = np.arange(sizes.sum()) + np.repeat(starts[rows] - np.cumsum(sizes) + sizes, sizes)
        table = np.zeros((len(rows), n_docs), dtype=np.int64)
        table[np.repeat(np.arange(len(rows)), sizes), docs[entry]] = impacts[entry]
        x, y = table[place[:len(some)]], table[place[len(some):]]
        joint[first:first + len(some)] = np.where((x > 0) & (y > 0), x + y, 0).max(axis=1)
    return pairs[here], joint


def impact_index(blocks: DataFrame, items: Items, n: int, length: int, name: str) -> DataFrame:
    """Work table with a row per block: postings with impacts, greatest impacts of terms, and joint ones of pairs."""
    schema = pa.schema([(c, pa.binary()) for c in ("doc_ids", "terms", "starts", "docs", "impacts", "most", "pairs", "joint")])
    weight, pairs, n_terms = items.weight, items.pairs, len(items.vocabulary)

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms, starts, docs = _array(row["terms"], "<i4"), _array(row["starts"]), _array(row["docs"], "<u4").astype(np.int64)
                tf, n_words = _array(row["tf"], "<u4").astype(np.int64), _array(row["n_words"])
                # Python numbers, as the product may pass 64 bits before it is divided
                m = np.array([10 + 90 * w * n // max(1, length) for w in n_words.tolist()], dtype=np.int64)
                impacts = np.repeat(weight[terms], np.diff(starts)) * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
                most = np.maximum.reduceat(impacts, starts[:-1]) if len(terms) else np.empty(0, dtype=np.int64)
                met, joint = joint_impacts(terms, starts, docs, impacts, pairs, n_terms, len(n_words))
                yield pa.RecordBatch.from_pylist([{
                    "doc_ids": row["doc_ids"], "terms": row["terms"], "starts": row["starts"], "docs": row["docs"], "impacts": impacts.tobytes(),
                    "most": most.tobytes(), "pairs": met.tobytes(), "joint": joint.tobytes(),
                }], schema=schema)

    return materialise(blocks.select("doc_ids", "n_words", "terms", "starts", "docs", "tf").mapInArrow(tidy(work), INDEX), name)


class Block:
    """One block of the index."""

    def __init__(self, row: dict, n_terms: int, reach: int) -> None:
        self.reach = reach
        self.doc_ids, self.starts, self.docs = _array(row["doc_ids"]), _array(row["starts"]), _array(row["docs"], "<u4").astype(np.int64)
        self.impacts, self.n_terms = _array(row["impacts"]), n_terms
        self.most = np.zeros(n_terms, dtype=np.int64)
        self.at = np.full(n_terms, -1)
        terms = _array(row["terms"], "<i4")
        self.most[terms] = _array(row["most"])
        self.at[terms] = np.arange(len(terms))
        self.pairs, self.joint = _array(row["pairs"]), _array(row["joint"])

    def bounds(self, terms: np.ndarray) -> list[int]:
        """What the first 0, 1, 2, ... terms can add to any document of the block.

        The best chain of disjoint pairs: a pair counts with the greatest of its joint impact and its two maxima, one
        that the index does not have with their sum.
        """
        most = self.most[terms]
        together = []
        for d in range(1, min(self.reach, len(terms) - 1) + 1):
            key = terms[:-d] * self.n_terms + terms[d:]
            k = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            both = most[:-d] + most[d:]
            if len(self.pairs):
                both = np.where(self.pairs[k] == key, np.maximum(np.maximum(most[:-d], most[d:]), self.joint[k]), both)
            together.append(both.tolist())
        most, out = most.tolist(), [0]
        for k, u in enumerate(most):
            best, between = out[k] + u, 0
            for d in range(1, min(len(together), k) + 1):
                best = min(best, out[k - d] + between + together[d - 1][k - d])
                between += most[k - d]
            out.append(best)
        return out

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[term]
        a, b = (self.starts[at], self.starts[at + 1]) if at >= 0 else (0, 0)
        return self.docs[a:b], self.impacts[a:b]

    def search(self, terms: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, score) of all documents that score ``floor`` or more; ``terms`` stand in the item's order."""
        terms = terms[self.at[terms] >= 0]
        bounds = self.bounds(terms)
        if bounds[-1] < floor:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        light = next(k for k in range(len(terms), -1, -1) if k == 0 or bounds[k] < floor)
        total = np.zeros(len(self.doc_ids), dtype=np.int64)
        for t in terms[light:]:
            docs, impacts = self.postings(t)
            total[docs] += impacts
        alive = np.flatnonzero(total)
        for k in range(light, 0, -1):
            alive = alive[total[alive] + bounds[k] >= floor]
            if not len(alive):
                break
            docs, impacts = self.postings(terms[k - 1])
            here = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            total[alive] += np.where(docs[here] == alive, impacts[here], 0)
        alive = alive[total[alive] >= floor]
        return self.doc_ids[alive], total[alive]


def search_index(index: DataFrame, items: Items, top: int) -> DataFrame:
    """(item, doc_id, score): of each item (by number) the ``top`` best documents that a task met."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    terms, n_terms, reach = items.terms, len(items.vocabulary), items.reach

    def work(batches):
        none = np.empty(0, dtype=np.int64)
        best = [(none, none)] * len(terms)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, n_terms, reach)
                for i, t in enumerate(terms):
                    ids, scores = best[i]
                    # equal scores go by doc_id, so the k-th score itself is still of interest
                    more, its = block.search(t, int(scores[-1]) if len(scores) >= top else 1)
                    if len(more):
                        ids, scores = np.concatenate((ids, more)), np.concatenate((scores, its))
                        order = np.lexsort((ids, -scores))[:top]
                        best[i] = ids[order], scores[order]
        for i, (ids, scores) in enumerate(best):
            if len(ids):
                known = pa.array(ids, mask=ids == _LAST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), known, pa.array(scores)], schema=schema)

    small_batches(index.sparkSession, 1)
    return index.mapInArrow(tidy(work), "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best rows of ``docs`` (doc_id, text) for each item (item_id, text).

    Ties go to the smaller doc_id, a null one last. Rows with equal doc_id rank each for itself. Texts that are null or
    hold no term score nothing and count as no document; an item without terms gets no rows; the rows of one item_id
    are one item with the terms of all. Empty tables on either side give no rows; other columns are ignored.
    Items are searched a bounded shard at a time, each over all documents.
    """
    out = None
    for shard in shards(items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")):
        # bounded by SHARD_BYTES, or one item
        held = Items([(r.item_id, r.text) for r in shard.collect()])
        if held.vocabulary or out is None:
            found = _search(docs, held, top)
            out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: Items, top: int) -> DataFrame:
    blocks = postings(docs, items.vocabulary, "search-postings")
    weight, n, length = term_weights(blocks, len(items.vocabulary))
    items.weigh(weight)
    found = search_index(impact_index(blocks, items, n, length, "search-index"), items, top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
