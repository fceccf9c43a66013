"""Repeated passages: suffix automata of reference shards give matching statistics, long spans are removed.

``SuffixAutomaton`` serves both uses:

- ``remove_reference_spans``: automata of the shards of a (bounded) reference are broadcast, documents stream
  past them.
- ``remove_repeats``: the reference is the corpus itself, each document against all earlier text. Broadcasting
  every shard to every document would be quadratic in the corpus, so text and shards meet by key instead: only
  windows that occur more than once in the corpus take part, runs of them with the same minimiser form one
  sequence, and the minimiser names the shard. Equal windows have equal minimisers, so a shard holds every
  occurrence of its windows. The shard's automaton grows in reading order, and the matching statistic of each
  word against what stands before it says which windows start earlier elsewhere.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.blocks import answers_by_block, ask_counts, buckets_for, frame, occurrence_codes, packed_blocks, unpack, with_id
from findmill.llm.common import blank, combine, materialise, mix, sliding_min, small_batches, tidy, words_of_texts

#: Words of a minimiser, and windows a shard of repeated passages holds on average.
MINIMISER, SHARD_WINDOWS = 3, 1 << 16
#: Largest number of words in a reference shard that is broadcast.
REFERENCE_WORDS = 1 << 20


class SuffixAutomaton:
    """Suffix automaton over sequences of words (any hashable)."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def start(self) -> None:
        """Begin another sequence; matches do not run over its start."""
        self.last = 0

    def extend(self, word) -> int:
        """Add a word; length of the longest text ending in it that already ended at an earlier place."""
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        q = nxt[p].get(word)
        if q is not None:
            # all since the sequence's start has been seen before
            if length[q] != length[p] + 1:
                q = self._split(p, q, word)
            self.last = q
            return length[q]
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        self.last = cur
        return length[link[cur]]

    def _split(self, p: int, q: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def statistics(self, words) -> list[int]:
        """For each word the length of the longest text ending in it that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(w)
            if to is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, the number of words of each, and the hashes of all windows within a text."""
    words, counts = words_of_texts(texts)
    hashes = combine(words, size)
    # a window that starts in the last size - 1 words of a text runs over its end
    inside = np.ones(len(words), dtype=bool)
    ends = np.cumsum(counts)
    for back in range(1, size):
        inside[(ends - back)[counts >= back]] = False
    return words, counts, hashes[inside[:len(hashes)]]


def cover(n_words: int, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window of ``size`` words that starts at one of ``ends``."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, ends, 1)
    np.add.at(edge, np.minimum(ends + size, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


OUT = "doc_id long, n_words long, n_removed long, kept string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(doc: int, words: list[bytes], gone: np.ndarray | None) -> dict:
    n = 0 if gone is None else int(gone.sum())
    kept = words if not n else list(compress(words, (~gone).tolist()))
    return {"doc_id": doc, "n_words": len(words), "n_removed": n, "kept": b" ".join(kept).decode("utf-8", "replace")}


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of ``docs`` (doc_id, text).

    A word goes if it lies in a window of ``size`` words whose word sequence also starts earlier: in a smaller
    doc_id, or in the same document before. Windows are judged on the input. ``kept`` is what stays, joined by
    one space. A null, empty or blank text has no words and '' is kept; shorter texts are kept whole. Rows without a doc_id are left out. Of rows
    with one doc_id the order of reading decides. No rows give no rows; other columns are ignored.
    """
    blocks = packed_blocks(docs, "repeat-blocks")
    columns = ("block", "doc_ids", "sizes", "texts")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = buckets_for(n_bytes // 6)
    asked_schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield frame(ask_counts(_windows(unpack(row)[1], size)[2], row["block"], n_buckets)[0], asked_schema)

    counts = answers_by_block(blocks.select(*columns).mapInArrow(tidy(ask), "bucket long, block long, keys binary"), occurrence_codes)

    # what later steps need of the counts: a bit per window of the corpus
    marked_schema = pa.schema([("block", pa.int64()), ("n_windows", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary()), ("often", pa.binary())])

    def mark(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.unique(_windows(unpack(row)[1], size)[2], return_inverse=True)[1]
                often = np.frombuffer(b"".join(row["answers"] or []), dtype=np.uint8)[own] > 0
                yield frame([{k: row[k] for k in columns} | {"n_windows": int(often.sum()), "often": np.packbits(often).tobytes()}], marked_schema)

    marked = materialise(
        blocks.select(*columns).join(counts, "block", "left").mapInArrow(tidy(mark), "block long, n_windows long, doc_ids binary, sizes binary, texts binary, often binary"), "repeat-marks")
    n_shards = buckets_for(0) if not (n := marked.agg(F.sum("n_windows")).first()[0]) else max(64, n // SHARD_WINDOWS)

    def sequences(row):
        """(texts, runs): runs are (shard, document, first window, windows, word hashes), by document and place."""
        ids, texts = unpack(row)
        flat, counts = words_of_texts(texts)
        words = np.split(flat, np.cumsum(counts)[:-1])
        n = np.maximum(0, counts - size + 1)
        often = np.unpackbits(np.frombuffer(row["often"], dtype=np.uint8), count=int(n.sum())).astype(bool)
        runs, ends = [], np.cumsum(n)
        for k in np.argsort(ids, kind="stable").tolist():
            w, own = words[k], often[ends[k] - n[k]:ends[k]]
            if not own.any():
                continue
            least = sliding_min(combine(w, MINIMISER), size - MINIMISER + 1)
            hits = np.flatnonzero(own)
            new = np.flatnonzero((np.diff(hits, prepend=-2) != 1) | (least[hits] != np.concatenate(([~least[hits[0]]], least[hits[:-1]]))))
            for a, b in zip(hits[new].tolist(), (hits[np.append(new[1:], len(hits)) - 1]).tolist(), strict=True):
                runs.append((int(mix(least[a:a + 1])[0] % np.uint64(n_shards)), k, a, b - a + 1, w[a:b + size]))
        return ids.tolist(), texts, words, runs

    def own_runs(runs, ids):
        """Per shard the distinct sequences of a block with their first place."""
        shards: dict[int, dict[bytes, tuple]] = {}
        for shard, k, a, _, w in runs:
            shards.setdefault(shard, {}).setdefault(w.tobytes(), (ids[k], a))
        return shards

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, _, runs = sequences(row)
                out = []
                for shard, found in own_runs(runs, ids).items():
                    head = np.array([[len(s) // 8, *place] for s, place in found.items()], dtype=np.int64)
                    out.append({"bucket": shard, "block": row["block"], "keys": len(head).to_bytes(8, "little") + head.tobytes() + b"".join(found)})
                yield frame(out, asked_schema)

    def judge(parts: list[bytes]) -> list[bytes]:
        """For each sequence sent, a bit per window: does the window start earlier anywhere in the corpus?"""
        places: dict[bytes, tuple] = {}
        sent = []
        for run in parts:
            n = int.from_bytes(run[:8], "little")
            head = np.frombuffer(run, dtype=np.int64, count=3 * n, offset=8).reshape(n, 3)
            at, own = 8 + 24 * n, []
            for length, doc, start in head.tolist():
                seq = run[at:at + 8 * length]
                at += 8 * length
                own.append((seq, (doc, start)))
                if seq not in places or (doc, start) < places[seq]:
                    places[seq] = (doc, start)
            sent.append(own)
        text = SuffixAutomaton()
        first: dict[bytes, np.ndarray] = {}
        for seq in sorted(places, key=places.__getitem__):
            text.start()
            first[seq] = np.array([text.extend(w) for w in np.frombuffer(seq, dtype=np.uint64).tolist()], dtype=np.int64)[size - 1:] >= size
        return [np.packbits(np.concatenate([first[s] if places[s] == place else np.ones(len(s) // 8 - size + 1, dtype=bool) for s, place in own])).tobytes() for own in sent]

    verdicts = answers_by_block(marked.drop("n_windows").mapInArrow(tidy(send), "bucket long, block long, keys binary"), judge)

    def remove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts, hashes, runs = sequences(row)
                shards = own_runs(runs, ids)
                replies = dict(zip(sorted(shards), row["answers"] or [], strict=True))
                early = {}
                for shard, found in shards.items():
                    bits, at = np.unpackbits(np.frombuffer(replies[shard], dtype=np.uint8)).astype(bool), 0
                    for s in found:
                        n = len(s) // 8 - size + 1
                        early[shard, s] = bits[at:at + n]
                        at += n
                starts: dict[int, list] = {}
                for shard, k, a, n, w in runs:
                    s = w.tobytes()
                    at_first = shards[shard][s] == (ids[k], a)
                    starts.setdefault(k, []).append(a + (np.flatnonzero(early[shard, s]) if at_first else np.arange(n)))
                out = []
                for k, doc in enumerate(ids):
                    gone = cover(len(hashes[k]), np.concatenate(starts[k]), size) if k in starts else None
                    out.append(_kept(doc, texts[k].split(), gone))
                yield frame(out, _OUT)

    return marked.drop("n_windows").join(verdicts, "block", "left").mapInArrow(tidy(remove), OUT)


def remove_reference_spans(docs: DataFrame, reference: DataFrame, size: int = 20, column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: spans of at least ``size`` words that ``reference`` (column ``text``) holds go.

    The reference is cut into shards of at most ``REFERENCE_WORDS`` words (never within a text); documents stream
    past one broadcast automaton after the other. Meant for lists such as test items. Nulls are empty texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards: list[list[list[bytes]]] = []
    room = 0
    for (text,) in reference.select(blank(column)).toLocalIterator():
        words = bytes(text).split()
        if len(words) >= size:
            if len(words) > room:
                shards.append([])
                room = REFERENCE_WORDS
            shards[-1].append(words)
            room -= len(words)
    texts = [spark.sparkContext.broadcast(s) for s in shards]

    def stream(batches):
        held = []
        for b in texts:
            automaton = SuffixAutomaton()
            for words in b.value:
                automaton.start()
                for w in words:
                    automaton.extend(w)
            held.append(automaton)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words), dtype=bool)
                for automaton in held:
                    for end, n in enumerate(automaton.statistics(words)):
                        if n >= size:
                            gone[end - n + 1:end + 1] = True
                out.append(_kept(doc, words, gone))
            yield frame(out, _OUT)

    return with_id(docs).mapInArrow(tidy(stream), OUT)


def kept_digest(removed: DataFrame) -> DataFrame:
    """The same rows with the SHA-256 of the kept words in place of the words."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["SuffixAutomaton", "kept_digest", "remove_reference_spans", "remove_repeats"]
