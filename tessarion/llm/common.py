"""Shared pieces: shared scratch tables, word splitting, hashing, connected components."""

from __future__ import annotations

import atexit
import re
import struct
import tempfile
import uuid

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is configured and all runs on this machine (tests)."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(own)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


_held: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what lies there goes with the process, or before by ``release``."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(release, spark)
    _held.append(path)
    return path


def held() -> tuple[str, ...]:
    """The scratch paths so far."""
    return tuple(_held)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch tables so far, but for those to keep: for callers whose results are written."""
    for path in [p for p in _held if p not in keep]:
        _held.remove(path)
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder's owner cleans up
        pass


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(docs: DataFrame, names: list[str]) -> list[str]:
    """Column names like ``names`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def is_held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id's decimal text modulo five equals ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased (and no other letter)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordCodes(dict):
    """64-bit codes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def word_codes(words: list[bytes], cache: WordCodes) -> np.ndarray:
    """Codes of words; ``cache`` keeps those of words seen before (and is emptied when large)."""
    if len(cache) > 200_000:
        cache.clear()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_HEAD = "<3sBII"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each one's byte planes, compressed, or as they are where they are few."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        small = a.nbytes <= 256
        data = a.tobytes() if small else press.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())
        out.append(struct.pack(_HEAD, a.dtype.str[1:].encode().ljust(3), small, len(a), len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    press, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(data):
        kind, small, n, size = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        kind = np.dtype("<" + kind.decode().strip())
        raw = data[at : at + size]
        if not small:
            raw = np.frombuffer(press.decompress(raw, max_output_size=n * kind.itemsize), np.uint8).reshape(kind.itemsize, n).T.tobytes()
        out.append(np.frombuffer(raw, kind))
        at += size
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser constants are fixed values)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``, of any type with an order: one row (node, root), root being the smallest node reached.

    Alternating star contraction: every node links its neighbours to its smallest neighbour until nothing changes, so
    the number of rounds is logarithmic and no node's whole neighbourhood is ever held in one place.
    """

    def told(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = told(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stash(small.where("a <> b").distinct(), "cc")
        if (after := told(now)) == before:
            break
        before = after
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
