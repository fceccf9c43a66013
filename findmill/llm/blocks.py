"""Documents cut into blocks, and per-key answers brought back to the blocks that asked.

A key that a third of all documents share (a word, a shingle, a passage) is sent once per block, not once
per document, so no task meets more rows of it than there are blocks. Answers come back in the order in
which a block sent its keys. Both ways the rows are binary runs, a few bytes a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import blank, give_back, materialise, small_batches, tidy

#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Keys that one task of the counting step receives at a time.
BUCKET_KEYS = 1 << 18

PACKED = "block long, n_docs long, n_bytes long, doc_ids binary, sizes binary, texts binary"


def pack_texts(texts: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(texts), 3)


def unpack(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts of a block row."""
    ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
    ends = np.cumsum(np.frombuffer(row["sizes"], dtype=np.int64))
    data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(ends[-1]))) if len(ends) and ends[-1] else b""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else []
    return ids, [data[a:b] for a, b in zip(starts, ends, strict=True)]


def batches_of_docs(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(block number, doc_ids, texts) of about ``limit`` bytes each."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and size + len(text) > limit:
                yield (part << 24) + number, ids, texts
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(doc)
            texts.append(text)
            size += len(text)
    if ids:
        yield (part << 24) + number, ids, texts


def frame(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def with_id(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes of the rows that have a doc_id."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text"))


def packed_blocks(docs: DataFrame, name: str) -> DataFrame:
    """Write the documents once as compressed blocks; later steps read these and agree on what a block is."""
    schema = pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])

    def pack(batches):
        for block, ids, texts in batches_of_docs(batches):
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            yield frame([{
                "block": block, "n_docs": len(ids), "n_bytes": int(sizes.sum()), "doc_ids": np.array(ids, dtype=np.int64).tobytes(),
                "sizes": sizes.tobytes(), "texts": pack_texts(texts),
            }], schema)

    small_batches(docs.sparkSession)
    return materialise(with_id(docs).mapInArrow(tidy(pack), PACKED), name)


def buckets_for(n_keys: int) -> int:
    """Number of key buckets: a power of two, so that a bucket is the leading bits of a hash."""
    want = max(64, n_keys // BUCKET_KEYS)
    return 1 << (want - 1).bit_length()


def bucket_edges(sorted_hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket starts in hashes sorted ascending, with the end."""
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))
    bounds = (np.arange(n_buckets, dtype=np.uint64) << shift) if n_buckets > 1 else np.zeros(1, dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, bounds), len(sorted_hashes))


def answers_by_block(asked: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``asked``: (bucket, block, keys binary). ``answer`` gets all key runs of a bucket, in the order of their
    blocks, and returns one answer run for each. Result: (block, answers), the runs joined in bucket order."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary())])

    def reply(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        order = sorted(range(len(blocks)), key=blocks.__getitem__)
        keys = table.column("keys").to_pylist()
        found = answer([keys[i] for i in order])
        give_back()
        return pa.table({"block": [blocks[i] for i in order], "bucket": [table.column("bucket")[0].as_py()] * len(order), "reply": found}, schema=schema)

    replies = asked.groupBy("bucket").applyInArrow(reply, "block long, bucket long, reply binary")
    # a block has one reply per bucket at most: what it gathers is bounded by its own size
    return replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("r")).select("block", F.col("r.reply").alias("answers"))


def occurrence_codes(runs: list[bytes]) -> list[bytes]:
    """For runs of (uint32 key, uint8 count in the block): a byte per key that grows with the total count.

    0 stands for a total of one; larger totals are given on a logarithmic scale, eight steps to a doubling.
    """
    keys = [np.frombuffer(r, dtype=np.uint32, count=len(r) // 5) for r in runs]
    counts = [np.frombuffer(r, dtype=np.uint8, offset=len(k) * 4) for r, k in zip(runs, keys, strict=True)]
    every, own = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(own, weights=np.concatenate(counts), minlength=len(every))
    code = np.where(total < 2, 0, np.clip(np.rint(8 * np.log2(np.maximum(total, 2))), 8, 255)).astype(np.uint8)[own]
    return [x.tobytes() for x in np.split(code, np.cumsum([len(k) for k in keys])[:-1])]


def ask_counts(hashes: np.ndarray, block: int, n_buckets: int) -> tuple[list[dict], np.ndarray]:
    """Rows that ask for the totals of a block's hashes, and the distinct hashes in the order of the answers."""
    every, times = np.unique(hashes, return_counts=True)
    edges = bucket_edges(every, n_buckets)
    bits = n_buckets.bit_length() - 1
    # the bits that follow the bucket's; two hashes that agree in them are counted as one, which callers allow for
    low = ((every << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    times = np.minimum(times, 255).astype(np.uint8)
    return [
        {"bucket": int(b), "block": block, "keys": low[edges[b]:edges[b + 1]].tobytes() + times[edges[b]:edges[b + 1]].tobytes()}
        for b in np.flatnonzero(np.diff(edges))
    ], every
