"""Benchmark passages in documents: SimHash windows, multi-index Hamming lookup, exact weighted-shingle verification.

An item counts as found in a document where the weighted Jaccard similarity (sum of smaller over sum of larger counts) of the item's
``shingle``-word shingles and those of an item-sized stretch of the document is at least ``similarity``.

Method: items of like sizes are a band, with a window of its own: ``span`` words, a fixed share of the item's size that the similarity
allows. Documents are cut into such windows on a grid of ``step`` words, and each item at all starts, so that the grid meets the item's
windows at some phase. Windows get a 64-bit SimHash of their words, weighted by length. Fingerprints within ``radius`` differ in at most ``radius`` bits, so of
``radius + 1`` blocks at least one is equal (pigeonhole): each window is looked up in one table for each block, which finds every item window
within the radius, and candidates are then verified exactly.

Why windows are shorter than the items: a SimHash of a whole item-sized stretch is near, but within no fixed radius for certain, so a
search by it alone has a recall below one. With windows of a size that follows the item's, none is missed: a stretch that reaches the similarity shares an unbroken run of words with the item; ``run_bound``
is the least such run, and a band's span + step - 1 does not exceed it. So at least one grid window lies within the run, whose
fingerprint equals an item window's; the radius adds altered windows on top. An item of 40 words is searched by windows of 13 words, one of
100 or more by windows of 24.

Scale: the texts are read once and nothing is dealt out but the hits; the items' index travels to the executors in slices of
about ``slice_items`` items or ``slice_chars`` characters (its bound), each slice being matched against all documents.

Verification looks at every stretch near a hit, its begin and end each within the slack that the similarity leaves: for one begin, all
ends at once, as the shared shingles are a running sum (an occurrence counts while the item has as many since the begin).

Defined results: null or empty texts and items match nothing; repeated items are one, and texts of the same id are tried each; an item of fewer words than ``shingle`` is one shingle, all of its words; words
compare in lower case and without punctuation round them; one row for each (document row, item) that matches, repeated rows included.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarion.llm.common import fresh_names

_OUTER = b".,;:!?\"'()[]{}"


@dataclass(frozen=True)
class Radar:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 3
    slice_items: int = 5_000
    slice_chars: int = 1 << 24
    #: Window run lengths that bands are rounded down to: geometric, so that sizes of any scale share few bands.
    growth: float = 1.4


def run_bound(words: int, how: Radar) -> int:
    """The least unbroken run of item words in any stretch that reaches the similarity to an item of so many words.

    With b breaks inside, the stretch lacks at least (shingle - 1) b of the item's n shingles and has as many of its own, so it
    shares at least similarity * (n + (shingle - 1) b) shingles, in b + 1 runs.
    """
    if words < how.shingle:
        return words
    n, cost, b = words - how.shingle + 1, how.shingle - 1, 0
    best = words
    while (shared := how.similarity * (n + cost * b)) <= n - cost * b + 1e-9:
        best = min(best, math.ceil(shared / (b + 1) - 1e-9) + cost)
        b += 1
    return best


def rung(bound: int, growth: float) -> int:
    """The largest step of the ladder 1, 2, 3, ... (each at least one more, later ``growth`` times the last) within ``bound``."""
    k = 1
    while (up := max(k + 1, int(k * growth))) <= bound:
        k = up
    return k


class Votes(dict):
    """The rows of words, as they stand in texts: each one's 64 votes (its weight where a bit of its code is set), side by side in a few 64-bit
    numbers, and its weight. Sums of such numbers may overflow from vote to vote, but the difference of two sums is the window's own
    votes again, as long as each of these fits its place: 8 bits for windows of up to 85 words, else 16."""

    def __init__(self, span: int) -> None:
        super().__init__()
        self.place = np.uint8 if 3 * span < 256 else np.uint16
        self.codes: list[int] = []
        self.weights: list[int] = []
        self.votes = np.zeros((0, 64 * np.dtype(self.place).itemsize // 8), np.uint64)

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(_OUTER) or raw
        row = self[raw] = len(self.codes)
        self.codes.append(xxhash.xxh3_64_intdigest(word))
        self.weights.append(1 if len(word) < 4 else 2 if len(word) < 9 else 3)
        return row

    def sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Running sums, over words, of votes and of weights."""
        if len(self) > 200_000:
            self.clear()
            self.codes, self.weights, self.votes = [], [], self.votes[:0]
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if fresh := self.codes[len(self.votes) :]:
            bits = np.unpackbits(np.array(fresh, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = bits.astype(self.place) * np.array(self.weights[len(self.votes) :], self.place)[:, None]
            self.votes = np.concatenate([self.votes, votes.view(np.uint64)])
        votes = np.zeros((len(words) + 1, self.votes.shape[1]), np.uint64)
        np.cumsum(self.votes[rows], axis=0, out=votes[1:])
        weights = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.array(self.weights, np.int64)[rows], out=weights[1:])
        return votes, weights

    def fingerprints(self, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, span: int) -> np.ndarray:
        """The SimHash of each window: bits that more than half of its weight votes for."""
        votes, weights = sums
        own = (votes[starts + span] - votes[starts]).view(self.place)
        half = (weights[starts + span] - weights[starts]) // 2
        return np.packbits(own > half[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(words: list[bytes], size: int) -> Counter:
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def raw_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words in lower case, without the punctuation round them (unless there is nothing else)."""
    return [w.strip(_OUTER) or w for w in raw_words(text)]


class Index:
    """The items' fingerprints, by band, with one lookup table for each block of bits."""

    def __init__(self, items: list[tuple[int, str]], how: Radar) -> None:
        self.how = how
        self.items = [(i, plain_words(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.counts = [shingles(w, how.shingle) for _, w in self.items]
        k = how.radius + 1
        edges = [64 * j // k for j in range(k + 1)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1), b - a) for a, b in zip(edges, edges[1:])]
        bands: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        runs = [rung(run_bound(len(words), how), how.growth) for _, words in self.items]
        self.span = max([1, *runs])
        known = Votes(self.span)
        for at, ((_, words), run) in enumerate(zip(self.items, runs)):
            step = max(1, (run + 1) // 4)
            span = run - step + 1
            starts = np.arange(len(words) - span + 1)
            bands[span, step] += [(int(f), at, int(s)) for f, s in zip(known.fingerprints(known.sums(words), starts, span), starts)]
        self.bands = []
        for (span, step), rows in sorted(bands.items()):
            prints = np.array([r[0] for r in rows], np.uint64)
            tables = []
            for shift, mask, bits in self.blocks:
                key = (prints >> shift) & mask
                order = np.argsort(key, kind="stable")
                there = np.zeros(1 << bits, bool) if bits <= 22 else None
                if there is not None:
                    there[key] = True
                tables.append((key[order], order, there))
            self.bands.append((span, step, prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables))

    def near(self, band: tuple, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) pairs within the radius."""
        _, _, own, _, _, tables = band
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for (shift, mask, _), (keys, order, there) in zip(self.blocks, tables):
            key = (prints >> shift) & mask
            live = np.flatnonzero(there[key]) if there is not None else np.arange(len(key))
            lo, hi = np.searchsorted(keys, key[live], "left"), np.searchsorted(keys, key[live], "right")
            n = hi - lo
            w = np.repeat(live, n)
            k = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            close = np.bitwise_count(prints[w] ^ own[k]) <= self.how.radius
            found.append((w[close], k[close]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def match(self, words: list[bytes], hits: set[tuple[int, int]]) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the items found near ``hits``, (item, start) guesses of one document."""
        guesses: dict[int, set[int]] = defaultdict(set)
        for at, guess in hits:
            guesses[at].add(guess)
        named: dict[int, tuple[float, int]] = {}
        for at, around in guesses.items():
            slack = int((1 - self.how.similarity) * max(1, len(self.items[at][1]) - self.how.shingle + 1) + 1e-9) + 1
            starts = {s for g in around for s in range(max(0, g - slack), min(len(words) - 1, g + slack) + 1)}
            found = self._best(words, at, starts, slack) if starts else None  # a piece of an item may stand where the whole of it can't
            if found is not None:
                item = self.items[at][0]
                named[item] = max(named.get(item, found), found, key=lambda x: (x[0], -x[1]))
        return [(item, sim, s) for item, (sim, s) in sorted(named.items())]

    def _best(self, words: list[bytes], at: int, starts: set[int], slack: int) -> tuple[float, int] | None:
        """The highest similarity to an item of a stretch with one of these starts, and its first word."""
        size, k, counts = len(self.items[at][1]), self.how.shingle, self.counts[at]
        best: tuple[float, int] | None = None
        if size < k:  # one shingle, all of the item's words
            return max(((1.0, s) for s in starts if words[s : s + size] == self.items[at][1]), key=lambda x: -x[1], default=None)
        whole = size - k + 1
        lo, hi = min(starts), min(len(words), max(starts) + size + slack)
        # By position: whether the item has the shingle, and where its count-th occurrence back is, before which a stretch must not begin.
        n = max(0, hi - k + 1 - lo)
        has, since = np.zeros(n, bool), np.full(n, -1, np.int64)
        spots: dict[tuple, list[int]] = defaultdict(list)
        for p in range(n):
            g = tuple(words[lo + p : lo + p + k])
            if c := counts.get(g):
                own = spots[g]
                own.append(p)
                has[p] = True
                if len(own) > c:
                    since[p] = own[-1 - c]
        if has.sum() < self.how.similarity * whole - 1e-9:
            return None
        for s in sorted(starts):
            p = s - lo
            first, last = max(1, whole - slack), min(n - p, whole + slack)  # numbers of shingles in the stretch
            if last < first:
                continue
            both = np.cumsum(has[p : p + last] & (since[p : p + last] < p))[first - 1 :]
            sims = both / (whole + np.arange(first, last + 1) - both)
            sim = float(sims.max())
            if sim >= self.how.similarity - 1e-12 and (best is None or (sim, -s) > (best[0], -best[1])):
                best = (sim, s)
                if sim == 1.0:
                    break
        return best

    def search(self, docs: list[list[bytes]], known: Votes) -> list[list[tuple[int, float, int]]]:
        """For each document, given by its raw words, (item, similarity, first word) of the items found in it."""
        lengths = np.array([len(d) for d in docs])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        every = [w for d in docs for w in d]
        if not every or not self.bands:
            return [[] for _ in docs]
        sums = known.sums(every)
        hits: list[set[tuple[int, int]]] = [set() for _ in docs]
        for band in self.bands:
            span, step, _, item_of, start_of, _ = band
            counts = np.maximum(0, (lengths - span) // step + 1)
            doc = np.repeat(np.arange(len(docs)), counts)
            local = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
            w, k = self.near(band, known.fingerprints(sums, begins[doc] + local, span))
            for d, item, start in set(zip(doc[w].tolist(), item_of[k].tolist(), (local[w] - start_of[k]).tolist())):
                hits[d].add((item, start))
        return [self.match([w.strip(_OUTER) or w for w in words], h) if h else [] for words, h in zip(docs, hits)]


def _found(docs: DataFrame, items: DataFrame, how: Radar) -> DataFrame:
    """(doc_id, code, item_id, similarity, first_word) of the items found in documents; code: a hash of the text."""
    spark = docs.sparkSession
    wanted = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    n, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    slices = max(1, -(-n // how.slice_items), -(-chars // how.slice_chars))
    wanted = wanted.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("code"))
    out = None
    for k in range(slices):
        held = sorted((r["item_id"], r["text"]) for r in wanted.where(F.col("slice") == k).collect())
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = Index(sent.value, how)
            known = Votes(index.span)
            for batch in batches:
                texts = batch.column("text")
                at = 0
                while at < batch.num_rows:  # as many documents as hold about a quarter million words
                    docs_, n, first = [], 0, at
                    while at < batch.num_rows and n < 250_000:
                        docs_.append(raw_words(texts[at].as_py()))
                        n += len(docs_[-1])
                        at += 1
                    rows = [(first + i, *m) for i, found in enumerate(index.search(docs_, known)) for m in found]
                    if rows:
                        take = pa.array([r[0] for r in rows], pa.int64())
                        own = [batch.column(c).take(take) for c in ("doc_id", "code")]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "code", "item_id", "similarity", "first_word"])

        part = base.mapInArrow(run, f"doc_id {kind}, code long, item_id long, similarity double, first_word long")
        out = part if out is None else out.union(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, how: Radar = Radar()) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) of the items found in documents; ``items(item_id, text)``."""
    return _found(docs, items, how).drop("code")


def without_benchmark(docs: DataFrame, items: DataFrame, how: Radar = Radar()) -> DataFrame:
    """The rows of ``docs`` that hold no item, rows of a null or repeated id each by their own text. Columns as in ``docs``."""
    ours = fresh_names(docs, ["id", "code"])
    found = _found(docs, items, how).select("doc_id", "code").distinct().toDF(*ours)
    same = docs["doc_id"].eqNullSafe(found[ours[0]]) & (F.xxhash64(docs["text"]) == found[ours[1]])
    return docs.join(found, same, "left_anti")
