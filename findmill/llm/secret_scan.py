"""Secrets in texts and in what the texts encode (recursive decoding worklist).

A text is the first layer. Each layer is searched for secrets and unwrapped: URL escapes and Unicode escapes of
the whole layer, base64 runs (also over line breaks and behind a separator), and compressed data inside them each
give a further layer, until no layer is new. Bytes of a layer that are no text stand in it as U+FFFD.
Compressed data are unpacked a window at a time, all members of them, whatever their size; a window ends where no
secret and no run can stand. Layers already seen at the same place end a cycle. Every character of a layer knows the span of the original
text it stands for, so what is found deep inside is reported where it starts and ends in the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findmill.llm.common import blank, small_batches

# The kinds in the order in which they are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Cheap tests on the bytes of a text: where all fail, nothing can be found.
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs over single line breaks, indented or not, and the marks behind which a run may begin anew.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_MARK = re.compile(r"[+/_-](?=[A-Za-z0-9+/_-]{16})")
_PART = re.compile(r"[^\r\n \t]+")
#: What a decoded layer must hold for anything to be found in it, and UTF-16 text of one-byte characters.
_WORTH = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){7,}[\t\n\r\x20-\x7e]?")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")

_BAD = dict.fromkeys(range(0xDC80, 0xDD00), "\ufffd")

#: Bytes that are unpacked at a time, and least bytes of a window of unpacked data.
PIECE, WINDOW = 1 << 18, 4 << 20
#: Bytes that stand in no secret, escape or run over lines: a window may end behind one (1 below, others 0).
_APART = bytes(int(i < 128 and not chr(i).isalnum() and chr(i) not in "+/_.=-\"':%\\{} \t\r\n") for i in range(256))

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("depth", T.IntegerType()), T.StructField("via", T.StringType()),
]))


def base_spans(text: str):
    """(kind, start, end) of the secrets of one layer; leftmost, not overlapping within a kind."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST["access"]:
            yield "access", m.start(), m.end()
    for m in _LONG_HEX.finditer(text):  # runs are maximal, so testing the length in the pattern drops the same ones
        yield "hex", m.start(), m.end()


class Layer:
    """Text with the original span of each character; ``at`` is None for the document itself."""

    __slots__ = ("at", "depth", "text", "via")

    def __init__(self, text: str, at: tuple | None, depth: int, via: str) -> None:
        self.text, self.at, self.depth, self.via = text, at, depth, via

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.at is None else (int(self.at[0][start]), int(self.at[1][end - 1]))


def _replaced(layer: Layer, pattern: re.Pattern, decode, via: str) -> Layer | None:
    """The layer with each match of ``pattern`` replaced by ``decode(match)``: pairs (character, source length)."""
    parts: list[str] = []
    starts, ends = array("q"), array("q")

    def copy(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if b > a:
            starts.frombytes((np.arange(a, b) if layer.at is None else layer.at[0][a:b]).tobytes())
            ends.frombytes((np.arange(a + 1, b + 1) if layer.at is None else layer.at[1][a:b]).tobytes())

    done = 0
    for m in pattern.finditer(layer.text):
        copy(done, m.start())
        at = m.start()
        for char, n in decode(m):
            a, b = layer.origin(at, at + n)
            parts.append(char)
            starts.append(a)
            ends.append(b)
            at += n
        done = m.end()
    if not done:
        return None
    copy(done, len(layer.text))
    return Layer("".join(parts), (np.frombuffer(starts, dtype=np.int64), np.frombuffer(ends, dtype=np.int64)), layer.depth + 1, f"{layer.via}/{via}")


def _url(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    for char in raw.decode("utf-8", "surrogateescape"):
        yield char, 3 * len(char.encode("utf-8", "surrogateescape"))


def _unicode(m: re.Match):
    code = int(next(g for g in m.groups() if g), 16)
    yield (chr(code) if code < 0x110000 else "\ufffd"), len(m[0])


def _unpacker(head: bytes) -> Callable | None:
    """What unpacks data that start so; None if they aren't compressed."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _unpacked(pieces: Iterable[bytes], make: Callable) -> Iterator[bytes]:
    """The data of all members, a piece at a time, as far as they can be read."""
    tool = make()
    for rest in pieces:
        out = b""
        while rest or len(out) == PIECE:
            try:
                out = tool.decompress(rest, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            if out:
                yield out
            if tool.eof:
                rest, out = tool.unused_data.lstrip(b"\0"), b""
                tool = make()
            else:
                rest = getattr(tool, "unconsumed_tail", b"")


def _bare(raw: bytes) -> bool:
    """Whether bytes are deflated data without any header: they end where the data say."""
    tool, rest, out = zlib.decompressobj(-15), raw, b""
    try:
        while not tool.eof and (rest or len(out) == PIECE):
            out = tool.decompress(rest, PIECE)
            rest = tool.unconsumed_tail
    except zlib.error:
        return False
    return tool.eof and not tool.unused_data


def _digest(pieces: Iterable[bytes]) -> bytes:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.digest()


def _opened(raw: bytes) -> tuple[Callable[[], Iterator[bytes]] | None, int]:
    """Opens the innermost data packed in ``raw``, and how often they are packed; data that hold themselves end it."""

    def inside(outer, make):
        return lambda: _unpacked(outer(), make)

    data, times, seen = (lambda: iter((raw,))), 0, set()
    make = _unpacker(raw) or ((lambda: zlib.decompressobj(-15)) if _bare(raw) else None)
    while make:
        inner = inside(data, make)
        head = next(inner(), b"")
        if not head:
            break
        data, times, make = inner, times + 1, _unpacker(head)
        if make:
            mark = _digest(data())
            if mark in seen:
                break
            seen.add(mark)
    return (data if times else None), times


def _windows(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Pieces joined to windows that end behind a byte no secret and no run may hold."""
    held, safe = bytearray(), 0
    for piece in pieces:
        at = piece.translate(_APART).rfind(1)
        safe = len(held) + at + 1 if at >= 0 else safe
        held += piece
        if len(held) >= WINDOW and safe:
            yield bytes(held[:safe])
            del held[:safe]
            safe = 0
    if held:
        yield bytes(held)


class _Same:
    """A span's end for every character of an unpacked layer."""

    def __init__(self, value: int) -> None:
        self.value = value

    def __getitem__(self, k):
        if isinstance(k, int):
            return self.value
        return np.full(k.stop - k.start if isinstance(k, slice) else len(k), self.value, dtype=np.int64)


def _offsets(text: str) -> np.ndarray:
    """The byte at which each character starts, and the end; an unreadable byte is one character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    sizes[(code >= 0xDC80) & (code < 0xDD00)] = 1
    return np.concatenate(([0], np.cumsum(sizes)))


def _texts(raw: bytes):
    """(text, offset of each character in ``raw`` and at last its end) of bytes in which something may be found."""
    if _WORTH.search(raw):
        text = raw.decode("utf-8", "surrogateescape")
        yield text.translate(_BAD), lambda: _offsets(text)
    for m in _WIDE.finditer(raw):
        text = m[0][::2]
        if _WORTH.search(text):
            yield text.decode(), lambda m=m: np.append(np.arange(m.start(), m.end(), 2), m.end())


def _unbase64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[:len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """Layers directly inside ``layer``."""
    if "%" in layer.text and (inner := _replaced(layer, _URL, _url, "url")):
        yield inner
    if "\\" in layer.text and (inner := _replaced(layer, _UNICODE, _unicode, "unicode")):
        yield inner
    for m in _LONG_RUN.finditer(layer.text):
        yield from _decoded(layer, m[0], np.arange(m.start(), m.end()), [0])
    if "\n" in layer.text:
        for m in _WRAPPED.finditer(layer.text):
            spots, begins = array("q"), []
            for part in _PART.finditer(m[0]):
                begins.append(len(spots))
                spots.frombytes(np.arange(m.start() + part.start(), m.start() + part.end()).tobytes())
            yield from _decoded(layer, "".join(_PART.findall(m[0])), np.frombuffer(spots, dtype=np.int64), begins)


def _decoded(layer: Layer, run: str, spots: np.ndarray, begins: list[int]) -> Iterator[Layer]:
    """Layers in a run of base64 digits that stand at ``spots``; what is encoded may start at ``begins`` or behind a mark.

    Starts that are a multiple of four digits apart decode alike, so text needs the first of each kind only.
    """
    begins = sorted({*begins, *(m.end() for m in _MARK.finditer(run))})
    first: dict[int, int] = {}
    for begin in begins:
        first.setdefault(begin % 4, begin)
    for begin in begins:
        head = _unbase64(run[begin:begin + 8]) if begin else b""
        if first[begin % 4] != begin and not _packed(head):
            continue
        raw = _unbase64(run[begin:])
        if not raw:
            continue
        a, b = layer.origin(int(spots[begin]), int(spots[-1]) + 1)
        inside, times = _opened(raw)
        if inside:
            for window in _windows(inside()):
                for text, _ in _texts(window):
                    yield Layer(text, (_Same(a), _Same(b)), layer.depth + 1, f"{layer.via}/base64{'/unpack' * times}")
        if first[begin % 4] != begin:
            continue
        for text, offsets in _texts(raw):
            # character to bytes to the base64 digits that hold them
            at = offsets()
            first_digit, last_digit = spots[begin + at[:-1] * 4 // 3], spots[np.minimum(len(spots), begin - (-at[1:] * 4 // 3)) - 1]
            if layer.at is None:
                starts, ends = first_digit, last_digit + 1
            else:
                starts, ends = layer.at[0][first_digit], layer.at[1][last_digit]
            yield Layer(text, (starts, ends), layer.depth + 1, f"{layer.via}/base64")


def _packed(head: bytes | None) -> bool:
    """Whether bytes start as compressed data does."""
    return bool(head) and (head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:5] == b"\xfd7zXZ" or len(head) > 2 and head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0)


def find_secrets(raw: bytes) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, depth, via) of a UTF-8 text, each place and kind once, at its least depth."""
    low = raw.lower()
    text = None
    if not (any(n in low for n in _NAMES) or b"AKIA" in raw or b"%" in raw or b"\\" in raw):
        text = raw.decode("utf-8", "replace")
        if not _LONG_RUN.search(text):
            return []
    found: dict[tuple[str, int, int], tuple[int, str]] = {}
    # a stack of open layers' insides: one window of each depth is held at a time
    work = [iter((Layer(raw.decode("utf-8", "replace") if text is None else text, None, 0, ""),))]
    seen: dict[tuple, int] = {}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.depth:
            key = (hash(layer.text), len(layer.text), *layer.origin(0, len(layer.text))) if layer.text else None
            if not key or seen.get(key, layer.depth + 1) <= layer.depth:
                continue
            seen[key] = layer.depth
        for kind, start, end in base_spans(layer.text):
            place = (kind, *layer.origin(start, end))
            if place not in found or layer.depth < found[place][0]:
                found[place] = (layer.depth, layer.via.lstrip("/"))
        work.append(_unwrapped(layer))
    rank = {k: i for i, k in enumerate(KINDS)}
    # what a cut run shows the beginning of is the same secret as the whole
    longest: dict[tuple[str, int, str], int] = {}
    for (kind, start, end), (depth, via) in found.items():
        if depth:
            longest[kind, start, via] = max(end, longest.get((kind, start, via), end))
    found = {k: v for k, v in found.items() if not v[0] or longest[k[0], k[1], v[1]] == k[2]}
    return sorted(((*k, *v) for k, v in found.items()), key=lambda r: (r[1], rank[r[0]], r[2]))


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "depth", "via"), r, strict=True)) for r in find_secrets(bytes(t))] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def masked_text(texts: pd.Series) -> pd.Series:
    def mask(raw):
        if raw is None:
            return None
        spans = [(r[1], r[2]) for r in find_secrets(bytes(raw))]
        text = bytes(raw).decode("utf-8", "replace")
        if not spans:
            return text
        parts, done = [], 0
        for start, end in sorted(spans):
            if start >= done:
                parts += [text[done:start], "[secret]"]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    return pd.Series([mask(t) for t in texts], dtype=object)


def scan_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, depth, via) of every row of ``docs``.

    Positions are code points, end exclusive; depth 0 is the text itself. A null or empty text has no spans.
    A kind found at one place in several layers is one span, of the least depth; among paths of that depth the first.
    Repeated rows are scanned each for itself; no rows give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", secret_spans(blank(column)).alias("spans"))


def mask_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span that holds a secret, encoded or not, replaced by ``[secret]``. Null stays null."""
    small_batches(docs.sparkSession)
    return docs.withColumn(column, masked_text(F.col(column).cast("binary")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
