"""Secrets in texts, also inside nested encodings.

Method: a worklist of layers. The text is the first layer; every layer is scanned for the three kinds of secret and for
encoded regions (URL escapes, backslash-u or entity escapes, base64, and base64 or escapes of gzip, zlib, zstandard, bzip2 or xz data).
A decoded region becomes a new layer whose characters map back to code points of the original text, and the list is worked
off until no layer decodes any more; a layer whose characters and origin were seen before isn't entered again (cycle detection).

Defined results: a null or empty text has no spans; output has one row for each input row, in whatever columns come with it;
bytes of a decoded region that aren't UTF-8 are characters of their own (lone surrogates), so what is beside them is scanned, and
UTF-16 is read too; base64 is decoded at all four alignments of a run and across wrapped lines, compressed data wherever a run
holds the beginning of a known format, all members of it; a decoded region without twelve printable characters in a row, the shortest
that can hold a secret, adds nothing. Compressed data of any size is read, as a stream: each ``window_bytes`` of it are a layer, and
windows overlap by ``overlap_bytes``, so memory is bounded and what is no longer than the overlap lies whole in some window. Data that
unpack to their own beginning are left (cycle detection again); a stream that breaks off gives what came before.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import html
import io
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same matches as runs filtered by length
_NAMED = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_VISIBLE = re.compile(r"[!-~]+")
_FULL = re.compile(r"\S+")
_UNI = re.compile(r"\\u\{?[0-9A-Fa-f]|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX]?[0-9A-Fa-f]+;")
_UNI_RUN = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
# Sixteen characters of base64 hold twelve bytes, the shortest secret. Possessive runs: a run that leads nowhere is passed over once.
_B64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_B64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)++(?:[A-Za-z0-9+/_-]++={0,2})?")
_PACKED = re.compile(r"H4sI|KLUv|Qlpo|[/_]Td6WF|(?<![A-Za-z0-9])e[AFJN]")  # how base64 of gzip, zstandard, bzip2, xz and zlib data begins
_HOLDS = re.compile(rb"[\x20-\x7e]{12}")
_HOLDS_16 = re.compile(rb"(?:[\x20-\x7e]\0){12}|(?:\0[\x20-\x7e]){12}")


@dataclass(frozen=True)
class Limits:
    window_bytes: int = 1 << 23
    overlap_bytes: int = 1 << 20


Spots = tuple[np.ndarray, np.ndarray]


def scan(layer: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of one layer, by start and then kind."""
    found = []
    if _NAMED.search(layer):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(layer) if len(m[2]) >= 6]
    if "AKIA" in layer:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(layer) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(layer)]
    return sorted(found)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _texts(raw: bytes) -> Iterator[tuple[str, Spots]]:
    """The decoded bytes as UTF-8 and, if they look it, as UTF-16; with the starts and ends in ``raw`` of each character."""
    if _HOLDS.search(raw):
        out = raw.decode("utf-8", "surrogateescape")
        if len(out) == len(raw):
            ends = np.arange(1, len(raw) + 1)
            yield out, (ends - 1, ends)
        else:
            code = _codes(out)
            sizes = np.select([(code < 0x80) | (code >> 8 == 0xDC), code < 0x800, code < 0x10000], [1, 2, 3], 4)  # U+DCxx: a byte that isn't UTF-8
            ends = np.cumsum(sizes)
            yield out, (ends - sizes, ends)
    if b"\0" in raw and (m := _HOLDS_16.search(raw)):  # the first such run tells the byte order and the alignment
        order = "utf-16-le" if raw[m.start() + 1] == 0 else "utf-16-be"
        begin = m.start() % 2
        out = raw[begin : begin + (len(raw) - begin) // 2 * 2].decode(order, "replace")
        sizes = np.where(_codes(out) > 0xFFFF, 4, 2)
        ends = begin + np.cumsum(sizes)
        yield out, (ends - sizes, ends)


_BROKEN = (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError)


class _Source(io.RawIOBase):
    """What a function gives, as a file; a fault in the data is its end."""

    def __init__(self, some: Callable[[int], bytes]) -> None:
        self.some = some

    def readable(self) -> bool:
        return True

    def readinto(self, space: bytearray) -> int:
        try:
            data = self.some(len(space))
        except _BROKEN:
            return 0
        space[: len(data)] = data
        return len(data)


def _inflater(source: io.BufferedReader) -> Callable[[int], bytes]:
    """Reads zlib streams that follow each other."""
    state = [zlib.decompressobj()]

    def some(n: int) -> bytes:
        while True:
            if state[0].eof:
                rest = state[0].unused_data
                state[0] = zlib.decompressobj()
            else:
                rest = state[0].unconsumed_tail
            rest = rest or source.read1(1 << 16)
            if not rest or (out := state[0].decompress(rest, n)):
                return out if rest else b""

    return some


def _opened(source: io.BufferedReader) -> io.BufferedReader | None:
    """The unpacked data of ``source``, all members, if it begins as a known compressed format."""
    head = source.peek(8)
    if head[:2] == b"\x1f\x8b":
        some = gzip.GzipFile(fileobj=source).read1
    elif head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0:
        some = _inflater(source)
    elif head[:4] == b"\x28\xb5\x2f\xfd":
        some = zstandard.ZstdDecompressor().stream_reader(source, read_size=1 << 12, read_across_frames=True).read1
    elif head[:3] == b"BZh":
        some = bz2.BZ2File(source).read1
    elif head[:6] == b"\xfd7zXZ\x00":
        some = lzma.LZMAFile(source).read1
    else:
        return None
    return io.BufferedReader(_Source(some), 1 << 16)


def _inflated(raw: bytes, limits: Limits) -> Iterator[str]:
    """The texts of the windows of compressed data, compressed again or not."""
    source = io.BufferedReader(io.BytesIO(raw))
    seen, deep = {raw[:4096]}, False
    while (inner := _opened(source)) is not None:
        head = inner.peek(4096)[:4096]
        if not head or head in seen:
            return
        seen.add(head)
        source, deep = inner, True
    if not deep:
        return
    held = b""
    while fresh := source.read(limits.window_bytes - len(held)):
        window = held + fresh
        for text, _ in _texts(window):
            yield text
        held = window[-limits.overlap_bytes :]


def _unescape(m: re.Match) -> str:
    s = m[0]
    if s[0] == "&":
        return html.unescape(s)
    code = int(s.strip("\\uUx{}"), 16)
    return chr(code) if code < 0x110000 else s


def _url_bytes(run: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of a run with its escapes decoded; and the starts and ends of each in the run."""
    raw = np.frombuffer(run.encode("ascii"), np.uint8).copy()
    keep = np.ones(len(raw), bool)
    ends = np.arange(1, len(raw) + 1)
    for m in _URL.finditer(run):
        k = m.start()
        raw[k] = int(run[k + 1 : k + 3], 16)
        keep[k + 1 : k + 3] = False
        ends[k] = k + 3
    return raw[keep].tobytes(), np.flatnonzero(keep), ends[keep]


def _plain_escapes(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A run with its backslash and entity escapes decoded; and the starts and ends of each character in the run."""
    out, starts, ends, k = [], [], [], 0
    for e in _UNI_RUN.finditer(run):
        if k < e.start():
            out.append(run[k : e.start()])
            starts.append(np.arange(k, e.start()))
            ends.append(starts[-1] + 1)
        inner = _unescape(e)
        out.append(inner)
        starts.append(np.full(len(inner), e.start()))
        ends.append(np.full(len(inner), e.end()))
        k = e.end()
    out.append(run[k:])
    starts.append(np.arange(k, len(run)))
    ends.append(starts[-1] + 1)
    return _surrogates("".join(out), np.concatenate(starts), np.concatenate(ends))


def _surrogates(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Joins escaped surrogate pairs; lone surrogates become the replacement character."""
    code = _codes(text)
    high, low = (code >= 0xD800) & (code < 0xDC00), (code >= 0xDC00) & (code < 0xE000)
    if not (high.any() or low.any()):
        return text, starts, ends
    pair = np.zeros(len(code), bool)
    pair[:-1] = high[:-1] & low[1:]
    second = np.roll(pair, 1)
    code = np.where(pair, 0x10000 + ((code - 0xD800) << 10) + np.roll(code, -1) - 0xDC00, np.where(high | low, 0xFFFD, code)).astype(np.uint32)
    ends = np.where(pair, np.roll(ends, -1), ends)
    return code[~second].tobytes().decode("utf-32-le"), starts[~second], ends[~second]


def _pieces(layer: str, limits: Limits) -> Iterator[tuple[int, int, str, Spots | None]]:
    """Decoded regions of a layer: (start, end, decoded, per character its starts and ends in the layer, or None where each
    character comes from the whole region)."""
    if "%" in layer and _URL.search(layer):
        for m in _VISIBLE.finditer(layer):
            if "%" not in m[0] or not _URL.search(m[0]):
                continue
            raw, starts, ends = _url_bytes(m[0])
            for text, (a, b) in _texts(raw):
                yield m.start(), m.end(), text, (m.start() + starts[a], m.start() + ends[b - 1])
            for text in _inflated(raw, limits):
                yield m.start(), m.end(), text, None
    if ("\\" in layer or "&#" in layer) and _UNI.search(layer):
        for m in _FULL.finditer(layer):
            if ("\\" in m[0] or "&#" in m[0]) and _UNI_RUN.search(m[0]):
                text, starts, ends = _plain_escapes(m[0])
                yield m.start(), m.end(), text, (m.start() + starts, m.start() + ends)
    wrapped = _B64_LINES.finditer(layer) if "\n" in layer else ()
    for m in (*wrapped, *_B64_RUN.finditer(layer)):
        run = m[0].rstrip("=")
        spot = np.arange(m.start(), m.start() + len(run))
        if "\n" in run:
            spot = m.start() + np.flatnonzero(~np.isin(_codes(run), [9, 10, 13, 32]))
            run = "".join(run.split())
        for k in range(4):
            for text, (a, b) in _texts(_unbase64(run[k:])):
                yield m.start(), m.end(), text, (spot[k + a * 8 // 6], spot[np.minimum(k + (b * 8 + 5) // 6, len(spot)) - 1] + 1)
        for x in _PACKED.finditer(run):
            for text in _inflated(_unbase64(run[x.start() :]), limits):
                yield m.start(), m.end(), text, None


def _unbase64(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run.translate({45: 43, 95: 47}) + "=" * (-len(run) % 4))


def find_secrets(text: str | None, limits: Limits = Limits()) -> tuple[list[tuple[int, int, int]], set[tuple[int, str, int]], int]:
    """(base matches of the text itself, every span as (start, kind, end) over all layers, number of layers)."""
    if not text:
        return [], set(), 0
    base = scan(text)
    spans = {(s, KINDS[k], e) for s, k, e in base}
    seen: set[tuple[int, int, bytes]] = set()
    # The worklist: iterators over the regions of a layer, with the starts and ends in the text of its characters (None: of the text
    # itself, or every character is the whole origin) and the layer's origin.
    work: list[tuple[Iterator, Spots | None, tuple[int, int] | None]] = [(_pieces(text, limits), None, None)]
    layers = 1
    while work:
        pieces, where, origin = work[-1]
        piece = next(pieces, None)
        if piece is None:
            work.pop()
            continue
        s, e, inner, at = piece

        def back(a: int, b: int, where: Spots | None = where, origin: tuple[int, int] | None = origin) -> tuple[int, int]:
            if origin is None:
                return a, b
            return origin if where is None else (int(where[0][a]), int(where[1][b - 1]))

        place = back(s, e)
        mark = (*place, hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest())
        if mark in seen or len(inner) == place[1] - place[0] and inner == text[place[0] : place[1]]:
            continue
        seen.add(mark)
        layers += 1
        if at is not None and origin is not None:
            at = None if where is None else (where[0][at[0]], where[1][at[1] - 1])
        for a, k, b in scan(inner):
            spans.add((place[0], KINDS[k], place[1]) if at is None else (int(at[0][a]), KINDS[k], int(at[1][b - 1])))
        work.append((_pieces(inner, limits), at, place))
    return base, spans, layers


_ORDER = {k: i for i, k in enumerate(KINDS)}


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], _ORDER[x[1]], x[2])))


def secret_scan(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """For each row (doc_id, text): the base counts and digest, all spans, and how many layers were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[list[int]] = [[], [], []]
            digest, spans, layers = [], [], []
            for x in batch.column("text"):
                base, found, deep = find_secrets(x.as_py(), limits)
                for k in range(3):
                    n[k].append(sum(b[1] == k for b in base))
                digest.append(hashlib.sha256(joined([(s, KINDS[k], e) for s, k, e in base]).encode()).hexdigest())
                spans.append(joined(list(found)))
                layers.append(deep)
            cols = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(layers, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
