"""Near-duplicate documents by Jaccard similarity of word shingles, with parity sketches.

Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct ``width``-word shingles.

Method: a sketch is a row of 64-bit parity words. A shingle's hash picks one word and its code is XORed into that word, so shingles
that both sets hold cancel out of the comparison and the number of unequal words never exceeds the symmetric difference. A pair that
links differs by at most (a + b)(1 - s)/(1 + s) shingles; sketches of a size band have more words than that, so at least one
word agrees (pigeonhole). Words that no shingle hit say nothing and are left out wherever a document has more hit words than the
greatest difference a link allows, which keeps the guarantee; otherwise they are keys too. Sizes are cut into bands that grow
by ``growth``; a document joins its own band, and the next one if a linked partner can be there.

Linked documents agree on more words than one: on at least the hit words of either less the greatest difference. So each document
drops that many keys less one, those that most documents share (shared passages make them): of the keys a linked pair shares, the
one that fewest share is never dropped by either. Equal (band, word, parity) keys that are left make groups. Documents with equal
sets are one node from the start.

A group of at most ``hot`` nodes (or offers of one side, see below) gives its pairs of different components as candidates. These are held against a small bit sketch of
each set (about a bit a shingle; the number of unequal bits never exceeds the symmetric difference either), and what may link is
verified on the full sets. A larger group is never paired up. It is put round a centre p, a node that is like many, and every member x is
replaced by its difference E(x) from p: what members have in common with p is gone from it. E(x) gives the link with p at once, and
|E(x) xor E(y)| = |x xor y|, so x and y link only if E(x) and E(y) share at least (|E(x)| + |E(y)| - d) / 2 elements, d being the
greatest difference of a link. A member outside p's component has |E(x)| > d, so in a pair of different components that number is one
at least, and each needs to offer only so many of its elements, fewest holders first, that one shared element must be among them
(prefix filter). Equal (p, element) offers make smaller groups, which are treated likewise until none is left. Only pairs
between different components are ever listed, and no link between components goes unseen.

Scale: texts are split and hashed once; only nodes of candidate pairs and large groups have their full sets made again. A block of
documents keeps its keys in ascending order, as gaps, each with the number of the entry (a node in a band) that has it. Sets that an earlier
block has too are taken out, by a list of their numbers that is broadcast (four bytes for each such entry), and the rest is cut into
ranges of keys. So an entry needs no name beside its keys, and what a key costs doesn't grow with the number of ranges. A
key that ``local`` or more nodes of a block hold is sent as a count only, so that no task gathers the holders of a hot key; these
nodes then meet the key's total in a join, which adaptive execution can split.

Keys have ``key_bits`` bits. Two keys that are equal by chance make candidates, which are verified; where two of one document are,
it drops one key less for each, so that no link is lost by that.

Defined results: null, empty and blank texts have no shingles and are alone; a text with fewer words than ``width`` is one shingle;
repeated rows are documents of equal sets, with the smallest id of all; null ids take part and are never the smallest unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarion.llm.common import components, fresh_names, lower_words, mix64, pack, stash, unpack, word_codes, WordCodes


@dataclass(frozen=True)
class Near:
    width: int = 5
    percent: int = 80
    growth: float = 1.5
    spare: float = 0.12
    bucket_bytes: int = 12_000_000
    block_keys: int = 800_000
    key_bits: int = 48
    local: int = 4
    hot: int = 64


def shingle_codes(words: list[bytes], width: int, cache: WordCodes) -> np.ndarray:
    """Distinct codes of the shingles, ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = word_codes(words, cache)
    width = min(width, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)])
    return np.unique(out)


def node_of(codes: np.ndarray) -> bytes:
    """A 128-bit code of a set."""
    return xxhash.xxh3_128_digest(codes.tobytes())


def band_edges(most: int, growth: float) -> list[int]:
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * growth)))
    return edges


def differ(a: int, b: int, percent: int) -> int:
    """The greatest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


def sketch_keys(codes: np.ndarray, how: Near) -> list[tuple[int, int, np.ndarray]]:
    """(band, keys that may be dropped, keys) of a set, for each band that it joins."""
    n = len(codes)
    edges = band_edges(n * 100 // how.percent, how.growth)
    own = next(j for j in range(len(edges) - 1) if edges[j] <= n < edges[j + 1])
    largest = n * 100 // how.percent  # of a linked partner
    out = []
    for j in range(own, len(edges) - 1):
        if edges[j] > largest:
            break
        top = edges[j + 1] - 1
        most = differ(top, top, how.percent)
        if j == own and not differ(n, min(largest, top), how.percent):
            continue  # only equal sets link here, and those are one node
        words = most + 2 + int(how.spare * most)
        salt = mix64(np.uint64(j + 1))
        slot = (mix64(codes ^ salt) % np.uint64(words)).astype(np.int64)
        parity = np.zeros(words, np.uint64)
        np.bitwise_xor.at(parity, slot, mix64(codes + salt))
        hit = np.zeros(words, bool)
        hit[slot] = True
        agree = int(hit.sum()) - differ(n, min(largest, top), how.percent)  # hit words that any linked partner shares, at least
        at = np.flatnonzero(hit) if agree > 0 else np.arange(words)
        keys = np.unique(mix64(parity[at] + mix64(at.astype(np.uint64) + salt)) >> np.uint64(64 - how.key_bits))
        out.append((j, max(0, agree - 1 - (len(at) - len(keys))), keys))
    return out


def bit_sketch(codes: np.ndarray) -> bytes:
    """Parity bits of a set, a power of two of them, at least as many as shingles."""
    bits = max(64, 1 << int(len(codes) - 1).bit_length())
    at = (mix64(codes + np.uint64(0x5EED)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(x: list[bytes], y: list[bytes], most: np.ndarray) -> np.ndarray:
    """For each pair of bit sketches, whether they leave room for at most ``most`` differences; longer ones are folded to the shorter's length."""
    sizes = np.array([(len(a) // 8, len(b) // 8) for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), bool)
    for n, m in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == n) & (sizes[:, 1] == m))
        a = np.frombuffer(b"".join(x[i] for i in at), np.uint64).reshape(len(at), -1, min(n, m))
        b = np.frombuffer(b"".join(y[i] for i in at), np.uint64).reshape(len(at), -1, min(n, m))
        apart = np.bitwise_xor.reduce(a, axis=1) ^ np.bitwise_xor.reduce(b, axis=1)
        out[at] = np.bitwise_count(apart).sum(axis=1) <= most[at]
    return out


_ENTRIES = pa.list_(pa.struct([("at", pa.int32()), ("band", pa.int32()), ("spare", pa.int32())]))
_HOT = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
_SCAN = [("doc_id", None), ("code", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()), ("block", pa.int64()), ("entries", _ENTRIES), ("data", pa.binary()), ("hot", _HOT)]


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """The byte planes of whole numbers, without the upper ones that are all zero."""
    size = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return list(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T[:size])


def _numbers(planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.view(np.uint64)[:, 0]


def pack_keys(keys: np.ndarray, owner: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending keys with the entries that have them, and how many have it (0: that one alone). Each plane is compressed by itself."""
    gaps, owners = _planes(np.diff(keys, prepend=np.uint64(0))), _planes(owner)
    at = np.flatnonzero(count)
    return pack(np.array([len(gaps), len(owners)], np.uint8), *gaps, *owners, at.astype(np.uint32), count[at].astype(np.uint32))


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n, m), *parts = unpack(data)
    keys, owner = np.cumsum(_numbers(parts[:n]), dtype=np.uint64), _numbers(parts[n : n + m]).astype(np.int32)
    count = np.zeros(len(keys), np.int32)
    count[parts[-2]] = parts[-1]
    return keys, owner, count


def _scan(docs: DataFrame, how: Near) -> DataFrame:
    """One pass over the texts. Rows of documents: doc_id, code (of the text), n_shingles, node, sketch, block, and entries (for the first
    row of a set in its block: the numbers in the block of its keys' owners, with their bands and the keys that may be dropped). Rows of blocks
    of documents: block and data (keys with their owners or, for the hot ones, their number), or hot (the owners behind such numbers)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def flush(keys: list[np.ndarray]) -> Iterator[tuple[pa.Array, pa.Array]]:
        every = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.ones(len(every), bool)
        first[1:] = every[1:] != every[:-1]
        runs = np.diff(np.append(np.flatnonzero(first), len(every)))
        many = np.repeat(runs >= how.local, runs)
        at = np.flatnonzero(many)
        for part in np.array_split(at, max(1, -(-len(at) // 50_000))) if len(at) else ():
            pairs = pa.StructArray.from_arrays([pa.array(every[part].view(np.int64)), pa.array(owner[part], pa.int32())], ["key", "at"])
            yield pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pairs)
        hold = ~many | first  # of the runs that only their number is sent of, the first
        count = np.where(many, np.repeat(runs, runs), 0)[hold]
        yield pa.array([pack_keys(every[hold], owner[hold], count)], pa.binary()), pa.nulls(1, _HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        seen: set[bytes] = set()
        block = TaskContext.get().partitionId() << 32
        keys, n = [], 0
        names = [c for c, _ in _SCAN]
        id_type = pa.null()

        def rows_of_block() -> Iterator[pa.RecordBatch]:
            for data, hot in flush(keys):
                none = [pa.nulls(1, t or id_type) for _, t in _SCAN[:5]]
                yield pa.RecordBatch.from_arrays([*none, pa.array([block], pa.int64()), pa.nulls(1, _ENTRIES), data, hot], names)

        for b in batches:
            id_type = b.schema.field("doc_id").type
            counts, nodes, bits, blocks, entries = [], [], [], [], []
            for t in b.column("text"):
                codes = shingle_codes(lower_words(t.as_py()), how.width, cache)
                node = node_of(codes) if len(codes) else None
                counts.append(len(codes))
                nodes.append(node)
                bits.append(bit_sketch(codes) if len(codes) else None)
                blocks.append(block)
                entries.append(None)
                if node is None or node in seen:
                    continue
                seen.add(node)
                own = []
                for band, free, k in sketch_keys(codes, how):
                    own.append({"at": len(keys), "band": band, "spare": free})
                    keys.append(k)
                    n += len(k)
                entries[-1] = own or None
                if n > how.block_keys:
                    yield from rows_of_block()
                    block, keys, n, seen = block + 1, [], 0, set()
            rows = b.num_rows
            cols = [b.column("doc_id"), b.column("code"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bits, pa.binary()), pa.array(blocks, pa.int64()), pa.array(entries, _ENTRIES), pa.nulls(rows, pa.binary()), pa.nulls(rows, _HOT)]
            yield pa.RecordBatch.from_arrays(cols, names)
        if n:
            yield from rows_of_block()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("code"))
    return rows.mapInArrow(run, f"doc_id {kind}, code long, n_shingles long, node binary, sketch binary, block long, entries array<struct<at:int,band:int,spare:int>>, data binary, hot array<struct<key:long,at:int>>")


def _pieces(scan: DataFrame, nodes: DataFrame, how: Near, buckets: int) -> DataFrame:
    """(bucket, block, data): the blocks' keys, cut into ranges, without those of sets that an earlier block has."""
    edges = np.array([-(-(k << how.key_bits) // buckets) for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data, again in zip(b.column("block").to_pylist(), b.column("data"), b.column("again").to_pylist()):
                keys, owner, count = unpack_keys(data.as_py())
                if again:
                    dead = np.zeros(max(int(owner.max()), *again) + 1, bool)
                    dead[again] = True
                    live = ~dead[owner] | (count > 0)
                    keys, owner, count = keys[live], owner[live], count[live]
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                there = np.flatnonzero(np.diff(cuts))
                out = [pack_keys(*(x[cuts[k] : cuts[k + 1]] for x in (keys, owner, count))) for k in there]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array(out, pa.binary())], ["bucket", "block", "data"])

    repeated = nodes.where("home.block < last_block").select("node", F.col("home.block").alias("home"))
    again = scan.where("entries is not null").join(repeated, "node").where("block <> home").select("block", F.explode("entries.at").alias("at"))
    again = again.groupBy("block").agg(F.collect_list("at").alias("again"))
    blocks = scan.where("data is not null").select("block", "data").join(F.broadcast(again), "block", "left")
    return blocks.select("block", "data", "again").mapInArrow(run, "bucket int, block long, data binary")


def _groups(scan: DataFrame, nodes: DataFrame, how: Near, buckets: int) -> DataFrame:
    """(key, node, n, block, at, spare, holders) of the keys that two or more entries have, an entry being a node in a band, told by ``block``
    and ``at``; ``holders``: about how many, the same for all of a key."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_keys(d.as_py()) for d in table.column("data")]
        piece = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        key, owner, count = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums = np.add.reduceat(np.maximum(count, 1)[order], begin, dtype=np.int64)
        shared, lengths = sums > 1, np.diff(np.append(begin, len(key)))
        keep = np.repeat(shared, lengths)
        key, order, holders = key[keep], order[keep], np.repeat(sums[shared], lengths[shared])
        out = {"key": key.view(np.int64), "block": table.column("block").to_numpy()[piece[order]], "at": owner[order], "holders": holders, "counted": count[order] > 0}
        return pa.table({k: pa.array(v) for k, v in out.items()})

    schema = "key long, block long, at int, holders long, counted boolean"
    found = stash(_pieces(scan, nodes, how, buckets).groupBy("bucket").applyInArrow(run, schema), "near-keys")
    totals = found.where("counted").groupBy("key").agg(F.max("holders").alias("holders"))
    named = scan.where("hot is not null").select("block", F.explode("hot").alias("x")).select("block", "x.*").join(totals, "key")
    columns = ["key", "block", "at", "holders"]
    # Entries of sets that an earlier block has are not in this table.
    entries = nodes.where("home is not null").select("node", F.col("n").cast("int").alias("n"), "home.block", F.explode("home.entries").alias("x")).select("node", "n", "block", "x.at", "x.spare")
    return found.where("not counted").select(*columns).union(named.select(*columns)).join(entries, ["block", "at"])


def _rarest(groups: DataFrame) -> DataFrame:
    """(key, node, n) without the ``spare`` most shared keys of each entry, and without keys that one node is left with."""
    most = Window.partitionBy("block", "at").orderBy(F.desc("holders"), "key")
    left = stash(groups.withColumn("rank", F.row_number().over(most)).where("rank > spare").select("key", "node", "n"), "near-rare")
    shared = left.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    return left.join(shared, "key", "left_semi")


def _sets(docs: DataFrame, how: Near) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                sets = [shingle_codes(lower_words(t.as_py()), how.width, cache) for t in b.column("text").slice(k, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "codes"])

    return docs.select("text").mapInArrow(run, "node binary, codes binary")


def _possible(pairs: DataFrame, nodes: DataFrame, how: Near) -> DataFrame:
    """The pairs (a, b) that their sizes and bit sketches allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = (t.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "m"))
            good = pa.array(may_link(t.column("x").to_pylist(), t.column("y").to_pylist(), differ(n, m, how.percent)))
            yield pa.RecordBatch.from_arrays([t.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), "n")
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(run, "a binary, b binary")


def _differences(pairs: DataFrame, sets: DataFrame, how: Near, tell: bool) -> DataFrame:
    """(a, b, n, m, e, linked) of the pairs (a, b): set sizes, size of the symmetric difference; with ``tell`` also ``family``, as it came, and
    ``elements``, those of the difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if tell:
                    apart = np.setxor1d(u, v, assume_unique=True)
                    found.append(apart.view(np.int64))
                    sizes.append((len(u), len(v), len(apart)))
                    continue
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                sizes.append((len(u), len(v), len(u) + len(v) - 2 * both))
            n, m, e = np.array(sizes, np.int64).reshape(-1, 3).T
            cols = [batch.column("a"), batch.column("b"), *(pa.array(z, pa.int64()) for z in (n, m, e)), pa.array(e <= differ(n, m, how.percent))]
            names = ["a", "b", "n", "m", "e", "linked"]
            if tell:
                edges = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int64)
                cols += [batch.column("family"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int64()))]
                names += ["family", "elements"]
            yield pa.RecordBatch.from_arrays(cols, names)

    left = sets.select(F.col("node").alias("a"), F.col("codes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("codes").alias("y"))
    schema = "a binary, b binary, n long, m long, e long, linked boolean" + (", family long, elements array<long>" if tell else "")
    own = ["a", "b", "x", "y", *(["family"] if tell else [])]
    return pairs.join(right, "b").join(left, "a").select(*own).mapInArrow(run, schema)


def _fits(a: Column, b: Column, how: Near) -> Column:
    return 100 * F.least(a, b) >= how.percent * F.greatest(a, b)


def _offers(family: DataFrame, labels: DataFrame, how: Near) -> DataFrame:
    """(key, node, n, label, long, short) of the elements that members of a family must offer, ``family(family, a, b, n, m, e, elements)``:
    its name, centre a, member b, their sizes, the difference.

    A member x outside the centre's component meets any y by its ``long`` offer and y's ``short`` one. With D(x, p) the greatest
    difference of a link, |E(x)| > D(x, p); |E(y)| is at least both 0 and |y| - |p|, and D grows with a size by less than that size does, so x
    shares at least (|E(x)| - D(x, p)) / 2 elements with a y that it links with, rounded up. Likewise y shares at least
    (|E(y)| + 1 - (D(x, y) - D(x, p))) / 2. And as |E(x)| - |E(y)| is D at most, each shares at least |E| less its own greatest D.
    """
    own = labels.select(F.col("node").alias("b"), F.col("label").alias("known"))
    centre = labels.select(F.col("node").alias("a"), F.col("label").alias("home"))
    rows = family.join(own, "b", "left").join(centre, "a", "left").withColumn("label", F.coalesce("known", "b")).withColumn("home", F.coalesce("home", "a"))
    loose, whole = F.lit(100 - how.percent), F.lit(100 + how.percent)
    top = F.floor((F.col("m") + F.floor(F.col("m") * 100 / how.percent)) * loose / whole)
    half = lambda x: F.floor((x + 1) / 2)
    larger = F.greatest(F.lit(0), F.ceil((F.col("m") - F.col("n")) * loose / whole))
    least_long = F.greatest(half(F.col("e") - F.floor((F.col("n") + F.col("m")) * loose / whole)), F.col("e") - top)
    least_short = F.greatest(half(F.col("e") + 1 - larger), F.col("e") - top)
    rows = rows.select("family", "b", "m", "e", "label", (F.col("label") != F.col("home")).alias("out"), least_long.alias("least_long"), least_short.alias("least_short"), "elements")
    rows = stash(rows, "near-family")
    live = rows.where("out").select("family").distinct()
    spread = rows.join(live, "family", "left_semi").select("family", "b", "label", F.explode("elements").alias("z"))
    # Elements whose holders are all of one component make no pair: they come first in the order, then those of few holders.
    mixed = spread.groupBy("family", "z").agg(F.count("*").alias("holders"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("family", "z", "holders")
    met = spread.select("family", "b", "z").join(mixed, ["family", "z"]).join(rows.drop("elements"), ["family", "b"])
    member = Window.partitionBy("family", "b")
    met = met.withColumn("place", F.col("e") - F.count("*").over(member) + F.row_number().over(member.orderBy("holders", "z")))
    met = met.withColumn("long", F.col("out") & (F.col("place") <= F.col("e") - F.col("least_long") + 1)).withColumn("short", F.col("place") <= F.col("e") - F.col("least_short") + 1)
    return met.where("long or short").select(F.xxhash64("family", "z").alias("key"), F.col("b").alias("node"), F.col("m").cast("int").alias("n"), "label", "long", "short")


def _components(docs: DataFrame, how: Near) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, code, n_shingles, node for each document; named: node, group, component_id for each node)."""
    base = docs.select("doc_id", "text")
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    scan = stash(_scan(base, how), "near-scan")
    rows = scan.where("n_shingles is not null").select("doc_id", "code", "n_shingles", "node", "sketch", "block", "entries")
    nodes = stash(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "code")).alias("keeper"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.min(F.when(F.col("entries").isNotNull(), F.struct("block", "entries"))).alias("home"), F.max(F.when(F.col("entries").isNotNull(), F.col("block"))).alias("last_block")), "near-nodes")
    groups = stash(_rarest(_groups(scan, nodes, how, max(1, -(-size // how.bucket_bytes)))), "near-groups")
    labels = _join_links(base, nodes, groups, how)
    full = nodes.join(labels, "node", "left")  # nodes without links have no label
    least = full.where("label is not null").groupBy("label").agg(F.min("first").alias("least"), F.min("keeper").alias("best"))
    named = full.join(least, "label", "left").select("node", F.coalesce("least", "first").alias("component_id"), F.coalesce("best", "keeper").alias("keeper"))
    return rows.select("doc_id", "code", "n_shingles", "node"), named


def near_components(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    rows, named = _components(docs, how)
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _join_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, how: Near) -> DataFrame:
    """(node, label) of the nodes in components of two or more."""
    spark = docs.sparkSession
    sets = spark.createDataFrame([], "node binary, codes binary")

    def with_sets(wanted: DataFrame, sets: DataFrame) -> DataFrame:
        """``sets`` with those of the nodes ``wanted`` that it lacks."""
        fresh = wanted.distinct().join(sets.select("node"), "node", "left_anti")
        chosen = stash(fresh.join(nodes.select("node", "keeper.doc_id", "keeper.code"), "node"), "near-wanted")
        ids = chosen.select("doc_id", "code").distinct()
        texts = docs.withColumn("code", F.xxhash64("text"))
        texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]) & (texts["code"] == ids["code"]), "left_semi")
        return sets.union(stash(_sets(texts, how).dropDuplicates(["node"]), "near-sets"))

    links = spark.createDataFrame([], "a binary, b binary")
    tested = links
    labels = spark.createDataFrame([], "node binary, label binary")
    open_ = groups.select("key", "node", "n", F.col("node").alias("label"), F.lit(True).alias("long"), F.lit(True).alias("short"))
    first = True
    while True:
        # Open groups: those in which a long offer meets a short one of another component.
        ends = [f(F.when(F.col(c), F.col("label"))).alias(f"{c}_{f.__name__}") for c in ("long", "short") for f in (F.min, F.max)]
        sizes = [F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in ("long", "short")]
        per = open_.groupBy("key").agg(*ends, *sizes).where((F.col("n_long") > 0) & (F.col("n_short") > 0) & (F.least("long_min", "short_min") != F.greatest("long_max", "short_max")))
        open_ = stash(open_.join(per.select("key", F.least("n_long", "n_short").alias("c")), "key"), "near-open")
        if not open_.head(1):
            return labels
        # At most ``hot`` pairs a row of the other side.
        cold = open_.where(F.col("c") <= how.hot)
        left = cold.where("long").select("key", "node", "n", "label", "short")
        right = cold.where("short").select("key", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "label", "long")))
        once = (F.col("node") < F.col("node_")) | ~(F.col("short") & F.col("long_"))
        pairs = left.join(right, "key").where(once & (F.col("label") != F.col("label_")) & _fits(F.col("n"), F.col("n_"), how))
        pairs = pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))
        pairs = stash(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = tested.union(pairs)
        pairs = stash(_possible(pairs, nodes, how), "near-possible")
        hot = open_.where(F.col("c") > how.hot).select("key", "node", "c")
        family = None
        if hot.head(1):
            # The centre: of a group's members the one of the largest groups in all, which has least of its own. At first, groups that
            # overlap take the greatest such centre that any of their members meets, and are one family, so that a cluster has few. Later
            # each group is a family round a member, which offers nothing: so groups get smaller until none is large.
            mass = hot.groupBy("node").agg(F.sum("c").alias("mass"))
            top = stash(hot.join(mass, "node").groupBy("key").agg(F.max(F.struct("mass", "node")).alias("top")), "near-top")
            if first:
                met = hot.join(top, "key").groupBy("node").agg(F.max("top").alias("top"))
                top = hot.join(met, "node").groupBy("key").agg(F.max("top").alias("top"))
            name = F.xxhash64("top.node") if first else F.col("key")
            family = hot.join(top, "key").select(name.alias("family"), F.col("top.node").alias("a"), F.col("node").alias("b"))
            family = stash(family.where("a <> b").distinct(), "near-round")
        both = pairs if family is None else pairs.union(family.select("a", "b"))
        sets = with_sets(both.select(F.explode(F.array("a", "b")).alias("node")), sets)
        found = _differences(pairs, sets, how, False).where("linked").select("a", "b")
        if family is not None:
            family = stash(_differences(family, sets, how, True), "near-differences")
            found = found.union(family.where("linked").select("a", "b"))
        links = stash(links.union(found), "near-links")
        labels = components(links).select("node", F.col("root").alias("label"))
        if family is None:
            return labels
        open_ = _offers(family, labels, how)
        first = False


def one_of_each(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """One row of each component, that of the smallest id (null ids last; of its texts the one of the smallest hash), with the columns of ``docs``;
    rows without shingles all stay. Of rows that repeat both id and text one stays."""
    rows, named = _components(docs, how)
    keepers = named.select("keeper.doc_id", "keeper.code").distinct()
    copies = rows.groupBy("doc_id", "code").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("size"))
    chosen = copies.where("size = 0").select("doc_id", "code", F.lit(1).alias("copies")).union(copies.where("size > 0").join(keepers, [copies["doc_id"].eqNullSafe(keepers["doc_id"]), copies["code"] == keepers["code"]], "left_semi").select("doc_id", "code", "copies"))
    ours = fresh_names(docs, ["id", "code", "copies"])
    chosen = chosen.toDF(*ours)
    same = docs["doc_id"].eqNullSafe(chosen[ours[0]]) & (F.xxhash64(docs["text"]) == chosen[ours[1]])
    kept = docs.join(chosen, same)
    out = kept.where(F.col(ours[2]) == 1).union(kept.where(F.col(ours[2]) > 1).dropDuplicates([ours[0], ours[1]]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

