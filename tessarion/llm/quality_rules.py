"""Rule-based quality verdicts: counts over words and lines, and compression bands.

Method: zstandard ratios (compressed bytes / UTF-8 bytes) of the whole document and, if it is longer than one chunk, of its
fixed-size chunks, which cover every byte: the last one ends with the text and overlaps the one before. Text that repeats
itself compresses far below what prose of its length does, and noise hardly compresses at all, so each length class has a
lower and an upper limit; a document is kept when its whole ratio lies within the band of its length and no more than
``max_bad_share`` of its bytes lie in chunks outside the chunk band. A document of at most one chunk has its whole ratio only.

Defined results: a null or empty text has no words and fails the base rule; null ids, repeated rows and extra columns pass
through untouched (one output row for each input row); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarion.llm.common import fresh_names

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)


@dataclass(frozen=True)
class Bands:
    """Limits by length. ``whole``: (from this many bytes, lowest ratio, highest ratio), ascending by length."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),  # a frame's overhead hides the text's own ratio
        (100, 0.30, 1.20),
        (400, 0.30, 0.90),
        (1_600, 0.28, 0.75),
        (6_400, 0.26, 0.70),
    )
    chunk_bytes: int = 512
    chunk: tuple[float, float] = (0.30, 0.84)
    max_bad_share: float = 0.2
    level: int = 3

    def limits(self, n: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.whole) if n >= least)


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(words) - len(known) < width:  # a window's second occurrence holds ``width`` words that were there before
        return 0
    coded = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    coded ^= coded >> np.uint64(32)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows += coded[k : k + n] * _POWERS[k]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def measure(text: str | None, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, bad_chunks, chunks, bad_bytes, kept)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line and not line.isspace():
            seen.add(line)
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    ratio = len(press.compress(raw)) / len(raw) if raw else None
    size = bands.chunk_bytes
    starts = [*range(0, len(raw) - size, size), len(raw) - size] if len(raw) > size else []
    low, high = bands.chunk
    bad = [k for k in starts if not low <= len(press.compress(raw[k : k + size])) / size <= high]
    bad_bytes = sum(min(size, k - before) for before, k in zip([-size, *bad], bad))
    low, high = bands.limits(len(raw))
    kept = not failed and ratio is not None and low <= ratio <= high and bad_bytes <= bands.max_bad_share * len(raw)
    return len(words), len(text or "") - spaces, len(raw.translate(None, _NOT_SYMBOLS)), dup_lines, repeats, failed, ratio, len(bad), len(starts), bad_bytes, kept


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks long, chunks long, bad_bytes long, kept boolean"


def quality_rules(docs: DataFrame, bands: Bands = Bands(), text: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``name`` of the measures and the verdict (in place of one so named); every row stays."""
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in SCHEMA.split(", ")]
    rules = pa.struct(list(zip(fields, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            found = [dict(zip(fields, measure(x.as_py(), bands, press))) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, rules)], [*batch.schema.names, name])

    plain = docs.drop(name)
    return plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), f"`{name}` struct<{SCHEMA.replace(' ', ':').replace(',:', ', ')}>"]))


def op9(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", "rules.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the base rule and the bands keep, with the columns of ``docs``."""
    (name,) = fresh_names(docs, ["rules"])
    return quality_rules(docs, name=name).where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
