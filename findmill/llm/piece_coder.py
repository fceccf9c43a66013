"""SentencePiece BPE encoding by a table of last tokens per prefix, and decoding.

Merging by priority gives every prefix of a text one encoding, and that of a prefix is that of a shorter prefix and
one more token. So one token per prefix, its last, tells the whole encoding. Among the vocabulary's pieces that end
at a place (found by an automaton) the last token is the one that merging would leave beside the last token of what
stands before it; which pairs of tokens stay apart is found once per pair by replaying the merges of both. Ids are
then read backwards from the end of the table. The work is linear in the text, however long a run without spaces.
"""

from __future__ import annotations

import codecs
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import give_back, small_batches

#: Runs that a worker remembers (twice as many for a while), their greatest length, and pairs of tokens; a full store of pairs starts anew.
RUNS, RUN_LENGTH, PAIRS = 1 << 18, 64, 1 << 20

_SPACE = "▁"
_START, _BARRIER, _NONE = -1, -2, -3


def _one_byte_only(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("findmill-byte", _one_byte_only)


class _Recent(dict):
    """Answers of ``work`` by key. When full, the older half that nobody asked for since the last time goes."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
            if len(key) > RUN_LENGTH:  # hardly comes again
                return found
        if len(self) >= RUNS:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class PieceCoder:
    """Encodes and decodes with a SentencePiece BPE model that has byte pieces and no unused ones."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        self.normalize = sp.normalize
        ids = range(sp.get_piece_size())
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.bytes)) or any(map(sp.is_unused, ids)):
            raise ValueError(f"{model_file}: only models with byte pieces and without unused pieces are supported")
        ordinary = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.text = {i: sp.id_to_piece(i) for i in ordinary}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for i, t in self.text.items()}
        self.merges = {i: m for i in ordinary if (m := self._merges(i))}
        self.automaton = ahocorasick.Automaton()
        for i in self.merges:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        surface = {b: bytes([k]) for k, b in enumerate(self.bytes)}
        surface |= {i: t.replace(_SPACE, " ").encode() for i, t in self.text.items()}
        self.surface = [surface.get(i, " ⁇ ".encode() if sp.is_unknown(i) else b"") for i in ids]
        self.control = {i for i in ids if sp.is_control(i)}
        self.run = self._run_pattern()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs = _Recent(self._ids)

    def _run_pattern(self) -> re.Pattern:
        """Runs between which no piece reaches: before a space mark, and round line ends and tabs.

        Whether that is so is a matter of the vocabulary; if not, the whole text is one run.
        """
        inner = {a + b for t in self.text.values() for a, b in pairwise(t)}
        if any(x[1] == _SPACE != x[0] for x in inner):
            return re.compile(r"(?s).+")
        apart = "".join(c for c in "\n\t\r" if not any(c in x for x in inner))
        return re.compile(f"{_SPACE}+[^{_SPACE}{apart}]*|[^{_SPACE}{apart}]+" + (f"|[{apart}]" if apart else ""))

    def _merges(self, token: int) -> tuple | None:
        """Scores of the merges that build a token, in order, and its first and last symbol before, between and after them.

        None for a piece that merging does not build from its characters.
        """
        parts = list(self.text[token])
        scores, first, last = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = [(self.score[a + b], -k) for k, (a, b) in enumerate(pairwise(parts)) if a + b in self.score]
            if not found:
                break
            score, k = max(found)
            parts[-k:2 - k] = [parts[-k] + parts[1 - k]]
            scores.append(score)
            first.append(parts[0])
            last.append(parts[-1])
        return (scores, first, last) if len(parts) == 1 else None

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens side by side gives these two."""
        (ours, _, edge), (theirs, begin, _) = self.merges[left], self.merges[right]
        i = j = 0
        while True:
            across = self.score.get(edge[i] + begin[j])
            a = ours[i] if i < len(ours) else None
            b = theirs[j] if j < len(theirs) else None
            # of equal scores the leftmost merge goes first
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def last_tokens(self, run: str) -> list[int]:
        """The last token of each prefix of a run, the empty one first; a character without a piece is a barrier."""
        known, pairs = self.id, self.pairs
        last = [_START, *[_NONE if c in known else _BARRIER for c in run]]
        for end, (token, size) in self.automaton.iter(run):
            if last[end + 1] == _NONE:
                before = last[end + 1 - size]
                if before >= 0:
                    apart = pairs.get((before, token))
                    if apart is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        apart = pairs[before, token] = self._apart(before, token)
                    if not apart:
                        continue
                last[end + 1] = token
        return last

    def _ids(self, run: str) -> bytes:
        """Ids of a run as 32-bit numbers, read backwards from its table of last tokens."""
        last = self.last_tokens(run)
        out = array("i")
        end = len(run)
        while end:
            if last[end] == _BARRIER:
                out.extend(self.bytes[b] for b in reversed(run[end - 1].encode()))
                end -= 1
            else:
                out.append(last[end])
                end -= len(self.text[last[end]])
        out.reverse()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        return b"".join(map(self.runs.__getitem__, self.run.findall(self.normalize(text)))) if text else b""

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces that are no UTF-8 become U+FFFD one by one, control pieces nothing, one leading space goes."""
        parts = [[]]
        for i in ids if not self.control.isdisjoint(ids) else ():
            if i in self.control:
                parts.append([])
            else:
                parts[-1].append(i)
        parts = [p for p in parts if p] or [ids]
        data = [b"".join(map(self.surface.__getitem__, p)) for p in parts]
        if parts[0] and self.text.get(parts[0][0], "").startswith(_SPACE):
            data[0] = data[0][1:]
        return "".join([d.decode("utf-8", "findmill-byte") for d in data])


_CODERS: dict[str, PieceCoder] = {}


def _coder(model_file: str) -> PieceCoder:
    """One coder per worker process."""
    if model_file not in _CODERS:
        _CODERS[model_file] = PieceCoder(model_file)
    return _CODERS[model_file]


def encode(text: Column, model_file: str) -> Column:
    """Ids (array of int) of a text column, as the SentencePiece library gives them without begin and end ids.

    ``model_file`` is a path that every executor has. A null or empty text has no ids.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = _coder(model_file)
        found = [coder.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0] + [len(f) // 4 for f in found])
        give_back()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, model_file: str) -> Column:
    """The text of a column of ids (arrays of int), as the library decodes them; null for null."""

    @F.arrow_udf("string")
    def texts(runs: pa.Array) -> pa.Array:
        coder = _coder(model_file)
        # one conversion for all ids, as those of Arrow lists come one by one
        flat, starts, sizes = runs.values.to_numpy(zero_copy_only=False), runs.offsets.to_pylist(), runs.value_lengths().to_pylist()
        return pa.array([None if n is None else coder.decode(flat[a:a + n].tolist()) for a, n in zip(starts, sizes, strict=False)], pa.string())

    # the condition keeps ids that another function computes from being computed once more inside this one
    return texts(F.when(ids.isNotNull(), ids))


def with_ids(docs: DataFrame, model_file: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``column``; other columns stay, one named ``into`` is replaced.

    Repeated rows are encoded each for itself, an empty table gives no rows, a text of any length is encoded whole.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(into, encode(F.col(column), model_file))
