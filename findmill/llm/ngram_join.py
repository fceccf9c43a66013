"""Near-duplicate documents: self-join of word-shingle sets on Jaccard similarity (adaptive multi-match prefixes).

The sets are ordered by one global order, rare shingles first. Two sets as similar as asked share at least L
shingles of their L-prefixes (the first |x| - ceil(t|x|) + L shingles). Each document chooses its own L: one if
its prefix promises few candidates, more as the expected number of candidates grows. A pair is verified only if
its prefixes share min(L of both) shingles.

- The order comes from counts over all documents. Shingles that occur once stand first in a prefix and can match
  nothing, so documents whose prefix holds only such shingles leave at once; the others keep their shared
  shingles only. The counts travel in block-wise runs (``blocks.py``), so a shingle of a third of all documents
  is one entry per block.
- Equal sets are one class; only its smallest id takes part.
- A prefix shingle with up to ``SMALL`` documents compares all of them. One with more compares all with a few
  pivots, links are merged to components, and only shingles whose documents still are in several components go
  on with more pivots; the last round compares the rest across components. Thus a group of n near copies costs
  n times the pivots, not n squared, and no link that joins two components is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.blocks import answers_by_block, ask_counts, buckets_for, frame, occurrence_codes, packed_blocks, unpack
from findmill.llm.common import combine, materialise, mix, tidy, word_hashes
from findmill.llm.components import connected_components

#: Largest number of documents of a prefix shingle that are all compared at once.
SMALL = 16
#: Pivots per shingle in the rounds for larger ones.
PIVOTS = (1, 8)
#: Rows and columns of a tile of the last round.
MINORS, MAJORS = 512, 1024
#: Candidates that one more required match is worth, and the most matches asked for.
CANDIDATES_PER_MATCH, MOST_MATCHES = 64, 8

SETS = "block long, doc_id long, n long, d1 long, d2 long"


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-cased (A-Z) UTF-8 bytes; fewer words are one shingle."""
    words = word_hashes(text.lower())
    if 0 < len(words) < size:
        return combine(mix(words + np.uint64(len(words))), len(words))
    return np.unique(combine(words, size))


def _share(percent: int, n):
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Documents link when 100 * |intersection| >= percent * |union|. component_id is the smallest doc_id reachable
    over links. A null, empty or blank text has no shingles, links with nothing and is its own component. Rows without a doc_id are left out. Repeated
    rows (same doc_id) come back once each. An empty table gives no rows; other columns are ignored.
    """
    blocks = packed_blocks(docs, "join-blocks")
    set_schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def digests(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = unpack(row)
                out = []
                for doc, text in zip(ids.tolist(), texts, strict=True):
                    s = shingle_set(text, size)
                    d1, d2 = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    out.append({"block": row["block"], "doc_id": doc, "n": len(s), "d1": int(d1.astype(np.int64)), "d2": int(d2.astype(np.int64))})
                yield frame(out, set_schema)

    # one row per document; equal sets are recognised by their size and two sums over 64-bit hashes
    sets = materialise(blocks.select("block", "doc_ids", "sizes", "texts").mapInArrow(tidy(digests), SETS), "join-sets")
    classes = materialise(sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "join-classes")
    n_buckets = buckets_for(sets.agg(F.sum("n")).first()[0] or 0)

    asked_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])

    def block_sets(row):
        ids, texts = unpack(row)
        return ids, [shingle_set(t, size) for t in texts]

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = block_sets(row)[1]
                yield frame(ask_counts(np.concatenate(found), row["block"], n_buckets)[0], asked_schema)

    codes = answers_by_block(blocks.select("block", "doc_ids", "sizes", "texts").mapInArrow(tidy(ask), "bucket long, block long, keys binary"), occurrence_codes)
    token_schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("matches", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def prefixes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, found = block_sets(row)
                every = np.unique(np.concatenate(found))
                code = np.frombuffer(b"".join(row["answers"] or []), dtype=np.uint8)
                out, taken = [], set()
                for k in np.argsort(ids, kind="stable"):  # of copies the smallest id, whatever the order of reading
                    doc, s = int(ids[k]), found[k]
                    n = len(s)
                    key = (n, int(s.sum(dtype=np.uint64)))
                    if not n or key in taken:
                        continue
                    taken.add(key)
                    c = code[np.searchsorted(every, s)]
                    shared = c > 0
                    first = n - _share(percent, n) + 1 - (n - int(shared.sum()))
                    if first <= 0:
                        continue
                    order = np.argsort(c[shared], kind="stable")  # the hashes are sorted: ties keep one global order
                    tokens, c = s[shared][order], c[shared][order]
                    candidates = float(np.exp2(c[:first] / 8.0).sum())
                    out.append({"doc_id": doc, "n": n, "first": first, "matches": int(min(MOST_MATCHES, 1 + candidates // (CANDIDATES_PER_MATCH * first))), "tokens": tokens.view(np.int64)})
                yield frame(out, token_schema)

    kept = blocks.join(codes, "block", "left").mapInArrow(tidy(prefixes), "doc_id long, n long, first int, matches int, tokens array<long>")
    # copies within a block are gone; those in other blocks go with the class's smallest id
    kept = materialise(kept.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "join-tokens")
    component = _link(kept, percent)
    by_class = classes.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    joined = sets.join(by_class, ["n", "d1", "d2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _link(kept: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the documents of ``kept`` that link with another."""
    shared = F.size("tokens").alias("shared")
    postings = kept.select("doc_id", "n", shared, F.explode(F.slice("tokens", F.lit(1), F.col("first"))).alias("token"))
    df = postings.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1")
    # a document that cannot reach the overlap asked for even with the shortest one of the shingle leaves it
    postings = materialise(postings.join(df, "token").filter(F.expr(f"{100 + percent} * shared >= {percent} * (n + least)")), "join-postings")
    small = postings.filter(F.col("m") <= SMALL)
    pairs = small.alias("x").join(small.alias("y"), F.expr("x.token = y.token and x.doc_id < y.doc_id") & _fits(percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    large = postings.filter(F.col("m") > SMALL).select("doc_id", "n", "shared", "token", F.col("doc_id").alias("comp"))
    links = None
    for n_pivots in PIVOTS:
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(n_pivots))
        pivots = large.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("doc_id", "n", "shared", "comp")).alias("p"))
        more = large.alias("x").join(pivots.select("token", "p.*").alias("y"), F.expr("x.token = y.token and x.comp <> y.comp") & _fits(percent))
        more = more.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
        found = materialise(_verified((pairs.union(more) if links is None else more).distinct(), kept, percent), "join-links")
        links = found if links is None else links.union(found)
        component = connected_components(links)
        labelled = large.drop("comp").join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", "shared", "token", F.coalesce("component", "doc_id").alias("comp"))
        split = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        large = materialise(labelled.join(split, "token", "left_semi"), "join-postings")
        if large.isEmpty():
            return component
    return connected_components(links.union(_rest(large, kept, percent)))


def _rest(large: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents that share a prefix shingle and still are in different components.

    Documents tied by such shingles are a cluster. In each, whoever isn't in the largest component is compared
    with all, in tiles; a tile returns one link per document and component, never pairs.
    """
    ties = large.join(large.groupBy("token").agg(F.min("doc_id").alias("b")), "token").select(F.col("doc_id").alias("a"), "b")
    cluster = connected_components(ties).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    docs = materialise(large.select("doc_id", "comp").distinct().join(cluster, "doc_id"), "join-rest")
    sizes = docs.groupBy("cluster", "comp").agg(F.count("*").alias("k"))
    tops = sizes.groupBy("cluster").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("k"))
    tops = materialise(tops.select("cluster", F.col("top.comp").alias("top"), F.ceil((F.col("k") - F.col("top.k")) / MINORS).alias("rows"), F.ceil(F.col("k") / MAJORS).alias("columns")), "join-rest")
    part = F.xxhash64("doc_id")
    every = docs.join(tops, "cluster")
    minor = every.filter("comp <> top").select("cluster", F.pmod(part, "rows").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("c"), "doc_id", "comp")
    major = every.select(F.col("cluster").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("r2"), F.pmod(part, "columns").alias("c2"), "doc_id", "comp")
    sets = kept.select("doc_id", "n", "tokens")
    minor = minor.join(sets, "doc_id")
    major = major.join(sets, "doc_id").select("k", "r2", "c2", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "comp", "n", "tokens")])

    def tile(x, y):
        out = {"a": [], "b": []}
        if len(x) and len(y):
            words, flat = np.unique(np.concatenate(list(y["y_tokens"])), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum([len(t) for t in y["y_tokens"]])[:-1]))
            ids, comp, n = (y[f"y_{c}"].to_numpy() for c in ("doc_id", "comp", "n"))
            for doc, own, size, tokens in zip(x["doc_id"], x["comp"], x["n"], x["tokens"], strict=True):
                at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
                has = np.zeros(len(words), dtype=np.int32)
                has[at[words[at] == tokens]] = 1
                common = np.add.reduceat(has[flat], starts).astype(np.int64)
                hit = np.flatnonzero((comp != own) & (100 * common >= percent * (n + size - common)))
                _, first = np.unique(comp[hit], return_index=True)
                out["a"] += [doc] * len(first)
                out["b"] += ids[hit[first]].tolist()
        return pd.DataFrame(out).astype("int64")

    return materialise(minor.groupBy("cluster", "r", "c").cogroup(major.groupBy("k", "r2", "c2")).applyInPandas(tile, "a long, b long"), "join-links")


def _fits(percent: int):
    """Whether the sizes of x and y, and of what they share with anyone, allow the similarity asked for."""
    p, q = percent, 100 + percent
    return F.expr(f"100 * least(x.n, y.n) >= {p} * greatest(x.n, y.n) and {q} * least(x.shared, y.shared) >= {p} * (x.n + y.n)")


def _verified(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough prefix shingles and are as similar as asked."""
    x = kept.select(*[F.col(c).alias(f"x_{c}") for c in kept.columns])
    y = kept.select(*[F.col(c).alias(f"y_{c}") for c in kept.columns])
    both = pairs.join(x, pairs.a == x.x_doc_id).join(y, F.col("b") == y.y_doc_id)
    head = [f"slice({s}_tokens, 1, {s}_first + {s}_matches - 1)" for s in "xy"]
    both = both.filter(F.expr(f"size(array_intersect({head[0]}, {head[1]})) >= least(x_matches, y_matches)"))
    common = F.expr("size(array_intersect(x_tokens, y_tokens))")
    return both.filter(100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)).select("a", "b")
