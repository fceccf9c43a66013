"""Token counts of documents (counted once per distinct pre-token).

A pre-token is a run of characters other than the six ASCII space characters. The tokenizer drops white space
and never forms a piece across it, so the number of pieces of a text is the sum over its pre-tokens. Each
distinct pre-token of the corpus is given to the tokenizer once; only its number of pieces is kept.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.blocks import answers_by_block, batches_of_docs, bucket_edges, buckets_for, frame, with_id
from findmill.llm.common import materialise, small_batches, tidy, word_hashes

ASKED = "bucket long, block long, keys binary"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a tokenizer file that every executor has. A null or empty text has 0 bytes and
    0 tokens. Rows without a doc_id are left out. Repeated rows are counted each for itself; an empty table gives no rows; other columns are ignored.
    A text without spaces is one pre-token, however long.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("docs", pa.binary())])

    def count_words(batches):
        for block, ids, texts in batches_of_docs(batches):
            counts = [Counter(t.split()) for t in texts]
            words = list(dict.fromkeys(chain.from_iterable(counts)))
            joined = b" ".join(words)
            order = np.argsort(word_hashes(joined), kind="stable")
            place = np.empty(len(words), dtype=np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            number = dict(zip(words, place.tolist(), strict=True))
            which = np.fromiter((number[w] for c in counts for w in c), dtype=np.uint32)
            times = np.fromiter((n for c in counts for n in c.values()), dtype=np.uint32)
            head = np.array([ids, [len(t) for t in texts], [len(c) for c in counts]], dtype=np.int64)
            data = len(ids).to_bytes(8, "little") + head.tobytes() + _pack_lists(which, times, head[2])
            yield frame([{"block": block, "n_words": len(words), "words": zstandard.compress(b" ".join([words[i] for i in order]), 3), "docs": zstandard.compress(data, 3)}], schema)

    rows = with_id(docs)
    blocks = materialise(rows.mapInArrow(tidy(count_words), "block long, n_words long, words binary, docs binary"), "token-blocks")
    n_buckets = buckets_for(blocks.agg(F.sum("n_words")).first()[0] or 0)
    asked_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                joined = zstandard.decompress(row["words"])
                words = joined.split()
                edges = bucket_edges(word_hashes(joined), n_buckets)
                yield frame([{"bucket": int(b), "block": row["block"], "keys": b" ".join(words[edges[b]:edges[b + 1]])} for b in np.flatnonzero(np.diff(edges))], asked_schema)

    def pieces(runs: list[bytes]) -> list[bytes]:
        from tokenizers import Tokenizer

        split = [r.split() for r in runs]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        # as the counts of words are small numbers, two bytes would do for most; a long word may need four
        size: dict[bytes, int] = {}
        coder = _open(Tokenizer, tokenizer)
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            size.update(zip(some, map(len, coder.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)), strict=True))
        return [np.fromiter(map(size.__getitem__, r), dtype=np.uint32, count=len(r)).tobytes() for r in split]

    asked = blocks.select("block", "words").mapInArrow(tidy(ask), ASKED)
    found = answers_by_block(asked, pieces)
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def add_up(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = zstandard.decompress(row["docs"])
                n = int.from_bytes(data[:8], "little")
                ids, n_bytes, n_words = np.frombuffer(data, dtype=np.int64, count=3 * n, offset=8).reshape(3, n)
                which, times = _unpack_lists(data[8 + 24 * n:], n_words)
                answers = np.frombuffer(b"".join(row["answers"] or []), dtype=np.uint32)
                each = answers[which].astype(np.int64) * times
                total = np.concatenate(([0], np.cumsum(each)))
                ends = np.cumsum(n_words)
                tokens = total[ends] - total[ends - n_words]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], schema=out_schema)

    return blocks.select("block", "docs").join(found, "block", "left").mapInArrow(tidy(add_up), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers by place value, which compress better than number by number."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _pack_lists(which: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> bytes:
    """Word numbers and frequencies of consecutive documents: numbers ascending, as steps from one to the next."""
    order = np.lexsort((which, np.repeat(np.arange(len(lengths)), lengths)))
    which = which[order].astype(np.int64)
    step = np.diff(which, prepend=0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    step[starts] = which[starts]
    return _planes(step) + _planes(times[order])


def _unpack_lists(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 8
    step, times = (np.frombuffer(data, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64) for at in (0, 4 * n))
    total = np.cumsum(step)
    begin = np.cumsum(lengths) - lengths
    before = np.concatenate(([0], total))[begin]
    return total - np.repeat(before, lengths), times


_OPEN: dict[str, object] = {}


def _open(kind, path: str):
    """One tokenizer per worker process."""
    if path not in _OPEN:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _OPEN[path] = kind.from_file(path)
    return _OPEN[path]
