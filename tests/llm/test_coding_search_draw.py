"""Piece coding, ranked search and importance draw against brute force, and the cases every operator must take."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from findmill.llm import importance, piece_coder, queries, ranked_search
from findmill.llm.common import read_table

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ka lo mi re su".split() for b in "ban cor del fen".split()] + ["Über", "ñandú", "门口", "x9"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, a row without an id, and columns whose names clash."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 90))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, " \n\t .,"), (83, sentence(rng, 40_000)), (84, "q" * 100_000), (85, rows[4][1]), (86, rows[4][1]), (7, rows[7][1]), (None, sentence(rng, 50)), (None, rows[9][1])]
    clash = ["ids", "decoded", "rank", "score", "item", "item_id", "term", "df", "weight", "bucket", "buckets", "n", "s", "t", "part", "row", "at", "shard", "n_words"]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(None).cast("string") for c in clash})


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randint(1, 12))) for i in range(30)] + [(40, None), (41, ""), (42, "absent Nowhere"), (43, "kaban"), (43, "kacor"), (44, sentence(rng, 5_000)), (3, sentence(rng, 3))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "shard", "size", "rank")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")


# Piece coding


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


def test_pieces_of_random_strings(model, library):
    coder, rng = piece_coder.PieceCoder(model), random.Random(1)
    some = [" ", "   ", "\n", "\r\n", "\t", "▁", "the", "ing", "The", "tion", "ñ", "门", "ﬁ", "é", "①", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "==", "--", "____", "0", "11", "(", ")", "qu", "zz"]
    for _ in range(6_000):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(40)))
        ids = np.frombuffer(coder.encode(text), dtype=np.int32).tolist()
        assert ids == library.encode(text), text
        assert coder.decode(ids) == library.decode(ids), text


def test_long_runs_and_forgetting(model, library, monkeypatch):
    monkeypatch.setattr(piece_coder, "RUNS", 50)
    monkeypatch.setattr(piece_coder, "PAIRS", 50)
    coder, rng = piece_coder.PieceCoder(model), random.Random(2)
    for text in ("a" * 50_000, " " * 50_001 + "a", "".join(rng.choice("abcdeABC012") for _ in range(50_000)), sentence(rng, 5_000)):
        assert np.frombuffer(coder.encode(text), dtype=np.int32).tolist() == library.encode(text)
    assert len(coder.runs) <= 50 and len(coder.pairs) <= 50


def test_decoding_any_ids(model, library):
    coder, rng = piece_coder.PieceCoder(model), random.Random(3)
    for _ in range(4_000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randrange(14))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_prefix_table_holds_each_prefix(model, library):
    """The last token of every prefix is the last that merging that prefix alone gives."""
    coder = piece_coder.PieceCoder(model)
    for run in ("▁internationalization", "▁▁▁▁▁▁▁foo", "▁aaaaaaaaab", "▁reconsidered门ñ"):
        last = coder.last_tokens(run)
        for end in range(1, len(run) + 1):
            assert last[end] == library.piece_to_id(merged(library, run[:end])[-1])


def merged(library, run):
    """Plain merging by score, leftmost first, one pair at a time."""
    parts = list(run)
    while True:
        known = [(library.get_score(library.piece_to_id(a + b)), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if library.piece_to_id(a + b)]
        if not known:
            return parts
        k = -max(known)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def test_piece_columns(docs, none, model, library):
    coded = piece_coder.with_ids(docs, model)
    assert set(coded.columns) == set(docs.columns)
    rows = coded.withColumn("back", piece_coder.decode(F.col("ids"), model)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.back == library.decode(r.ids)
    assert piece_coder.with_ids(none[0], model).count() == 0


def test_piece_query(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_piece_coding(spark, SF).collect()}

    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = {}
    for r in read_table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    assert got == want


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain_search(docs, items, top):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n, length = sum(1 for _, c in bags if c), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in bags:
            m = 10 + 90 * sum(c.values()) * n // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if gone else doc, -s) for k, (s, gone, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def searched(docs, items, top=10):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked_search(docs, items, top).collect()), key=repr)


@pytest.mark.parametrize("top,block_docs,reach,shard", [(10, 2_048, 3, 1 << 22), (3, 7, 3, 1 << 22), (10, 9, 1, 20_000), (200, 16, 2, 1 << 22)])
def test_search_equals_brute_force(docs, items, monkeypatch, top, block_docs, reach, shard):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(ranked_search, "REACH", reach)
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], top)
    assert searched(docs, items, top) == want


def test_bounds_hold_and_pairs_tighten():
    """Bounds of the first terms are never below what a document scores, and less than the sum of the maxima when terms avoid each other."""
    rng = np.random.default_rng(4)
    for turn in range(300):
        n_terms, n_docs = 10, 12
        table = rng.integers(1, 100, (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < (0.3, 0.08)[turn % 2])
        table[0, 0] += 1
        term, doc = np.nonzero(table)
        terms, starts = np.unique(term, return_index=True)
        starts = np.append(starts, len(term))
        order = rng.permutation(n_terms).astype(np.int64)
        pairs = np.unique([order[i] * n_terms + order[i + d] for d in (1, 2, 3) for i in range(n_terms - d)])
        impacts = table[term, doc]
        met, joint = ranked_search.joint_impacts(terms, starts, doc, impacts, pairs, n_terms, n_docs)
        row = {"doc_ids": np.arange(n_docs), "starts": starts, "docs": doc.astype("<u4"), "impacts": impacts, "terms": terms.astype("<i4"), "most": table[terms].max(axis=1), "pairs": met, "joint": joint}
        block = ranked_search.Block({k: v.tobytes() for k, v in row.items()}, n_terms, 3)
        bounds = block.bounds(order)
        most = np.cumsum(np.sort(table.max(axis=1))[::-1])
        here = order[block.at[order] >= 0]  # what search() bounds: terms that the block lacks leave gaps between the pairs
        for k, bound in enumerate(block.bounds(here)):
            assert bound >= table[here[:k]].sum(axis=0).max(initial=0)
        for k in range(n_terms + 1):
            assert bounds[k] >= table[order[:k]].sum(axis=0).max(initial=0)
            assert bounds[k] <= table.max(axis=1)[order[:k]].sum() <= most[-1]
        for floor in (1, 60, 150, 300):
            ids, scores = block.search(order, floor)
            want = table.sum(axis=0)
            assert sorted(zip(ids.tolist(), scores.tolist(), strict=True)) == [(i, s) for i, s in enumerate(want.tolist()) if s >= floor]
    apart = ranked_search.Block({"doc_ids": np.arange(2).tobytes(), "starts": np.array([0, 1, 2]).tobytes(), "docs": np.array([0, 1], dtype="<u4").tobytes(), "impacts": np.array([50, 60]).tobytes(),
                                 "terms": np.array([0, 1], dtype="<i4").tobytes(), "most": np.array([50, 60]).tobytes(), "pairs": np.array([1]).tobytes(), "joint": np.array([0]).tobytes()}, 2, 3)
    assert apart.bounds(np.array([0, 1])) == [0, 50, 60]


def test_search_of_nothing(docs, items, none):
    assert searched(none[0], items) == [] and searched(docs, none[1]) == [] and searched(*none) == []


# Importance draw


def plain_draw(docs, target, n_buckets, longest, least, percent):
    def runs(text):
        words = re.findall(importance.WORD, lower(text))
        return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    def bucket(run):
        return zlib.crc32(run.encode()) % n_buckets

    mine = [(i, *runs(t)) for i, t in docs]
    s = Counter(bucket(x) for _, _, f in mine for x in f)
    t = Counter(bucket(x) for text in target for x in runs(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + n_buckets) / ((s[b] + 1.0) * (big_t + n_buckets)))) for b in s}
    rows = []
    for i, n, f in mine:
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[:len(may) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n_buckets,longest,percent", [(10_000, 1, 10), (97, 3, 50), (65_536, 2, 100)])
def test_draw_equals_brute_force(docs, items, n_buckets, longest, percent):
    drawn = importance.draw(importance.importance_weights(docs, items, n_buckets, longest), 20, percent)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in drawn.collect()), key=repr)
    want = plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], n_buckets, longest, 20, percent)
    assert got == want


def test_words_by_the_library_are_those_of_the_pattern():
    rng, split = random.Random(8), importance.splitter()
    some = ["a", "Z", "9", " ", "\n", "ñ", "É", "门", "😀", "_", "@", "\x00", "\x7f", "\x80", " ", "k", "x"]
    for _ in range(2_000):
        text = lower("".join(rng.choice(some) for _ in range(30)))
        assert [w for w, _ in split.pre_tokenize_str(text)] == re.findall(importance.WORD, text)


def test_draw_of_nothing(docs, none):
    assert importance.draw(importance.importance_weights(none[0], docs)).count() == 0
    alone = importance.draw(importance.importance_weights(docs, none[0])).collect()
    assert len(alone) == docs.count() and {r.weight for r in alone if not r.n_features} == {0}
    with pytest.raises(ValueError):
        importance.importance_weights(docs, docs, n_buckets=1 << 17)
