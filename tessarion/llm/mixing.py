"""Mixing sources to target weights.

Method: each source's words, documents in a pseudorandom but fixed order, are packed into blocks of ``block_words`` words. One output
shard after the other draws its source counts from a multinomial law, over what the quotas have left; a source that has nothing left is
out of the draw, and the last shard takes the rest, so the draws make the mix and quotas are met to the block. A source's k-th slot
takes the block that a pseudorandom permutation of the block indices (a fresh one for each pass over the source) gives for k, and
slots meet blocks by index. Within a shard the slots of all sources lie in a pseudorandom order. ``mixture`` gives the mix itself, as
the ranges of documents' words that each slot holds; ``filled`` gives its text; ``mix`` gives what each document contributed, counted
from the mix.

Since a quota is at most three passes, no block, and so no document, is taken more than three times.

Scale: positions are two-level prefix sums (hash buckets of a source, then rows of a bucket), so no window ever spans a source; rows that
repeat id, source and text are one row with a count until they have positions. The driver holds a few numbers for each source and
shard: sources are named by hand, and there may be as many as ``max_sources``; beyond that the mix is refused.

Defined results: null texts have size 0; documents of size 0 take 0; null sources form a source of their own, the last; repeated
rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarion.llm.common import WORD, stash


@dataclass(frozen=True)
class Mix:
    block_words: int = 64
    shards: int = 64
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    most: float = 3.0
    rounds: int = 8
    seed: int = 17
    max_sources: int = 100_000
    task_slots: int = 500_000


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, each at most ``most`` times its size, the excess shared again by weight."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def shard_counts(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts (shards x sources) whose rows are level and whose columns add up to ``quota``: multinomial draws from what is left."""
    left = quota.astype(np.int64).copy()
    total = int(left.sum())
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(left)), np.int64)
    for s in range(shards):
        want = total // shards + (s < total % shards)
        while want:
            draw = np.minimum(rng.multinomial(want, left / left.sum()), left)  # what a source no longer has is drawn again
            out[s] += draw
            left -= draw
            want -= int(draw.sum())
    return out


def permuted(pos: Column, n: Column, key: Column, rounds: int) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not rounds after a rotation), chosen by ``key``."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), key, r).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    first = F.pmod(pos + F.pmod(F.xxhash64(key), n), n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first.cast("long"), turn)


def mixture(docs: DataFrame, how: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, source, text)``, and its documents.

    The mix: shard, slot (0, 1, ... in its shard), si (the source's number), source, block, at (the first word's place in the block),
    doc_id, code (hash of the text, as ids may repeat), skip (words of the document before the range), words (in the range), start.
    The documents, one row for each of ``docs``: doc_id, code, size, source_size, target, si, source, start (words of its source before it).
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("code"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.groupBy("doc_id", "source", "code", "size").agg(F.count("*").alias("copies"))
    sized = stash(sized.withColumn("h", F.xxhash64(F.lit(how.seed), "doc_id", "code")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("s"), F.count("*").alias("n")).limit(how.max_sources + 1).collect()
    if len(found) > how.max_sources:
        raise ValueError(f"more than {how.max_sources} sources")
    per_source = [(r["source"], r["s"], r["n"]) for r in found]
    per_source.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in per_source]
    aims = targets(sizes, [how.weights[i % len(how.weights)] for i in range(len(sizes))], how.most)
    blocks = [-(-s // how.block_words) for s in sizes]
    quota = np.array([min(round(a * b / s), math.floor(how.most * b)) if s else 0 for a, b, s in zip(aims, blocks, sizes)], np.int64)
    plan = spark.createDataFrame([(r[0], i, r[1], a, b) for i, (r, a, b) in enumerate(zip(per_source, aims, blocks))], "source string, si int, source_size long, target double, blocks long")
    counts = shard_counts(quota, how.shards, how.seed)
    first = np.cumsum(counts, axis=0) - counts  # of a source's slots, those of earlier shards
    before = np.cumsum(counts, axis=1) - counts  # of a shard's slots, those of earlier sources
    draws = spark.createDataFrame(
        [(s, i, blocks[i], int(first[s, i]), int(counts[s, i]), int(before[s, i]), int(counts[s].sum())) for s in range(how.shards) for i in range(len(sizes)) if counts[s, i]],
        "shard int, si int, blocks long, first long, n long, before long, whole long",
    )

    step = 1 << 14
    held = ["shard", "si", "blocks", "first", "n", "before", "whole"]
    runs = draws.select(*held, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))).alias("run"))
    # By number, so that adaptive execution leaves these small rows, which become many, in as many tasks.
    runs = runs.repartition(max(how.shards, -(-int(quota.sum()) // how.task_slots)), "si", "first", "run")
    slots = runs.select(*held, F.explode(F.sequence(F.col("run") * step, F.least(F.col("n"), (F.col("run") + 1) * step) - 1)).alias("k"))
    key = F.xxhash64(F.lit(how.seed), "si", F.expr("(first + k) div blocks"))
    block = permuted(F.expr("(first + k) % blocks"), F.col("blocks"), key, how.rounds)
    slots = slots.select("shard", permuted(F.col("before") + F.col("k"), F.col("whole"), F.xxhash64(F.lit(how.seed), "shard"), how.rounds).alias("slot"), "si", block.alias("block"))

    rows = sum(r[2] for r in per_source)
    buckets = max(1, math.isqrt(rows))  # level: as many buckets as rows in one
    rich = sized.join(F.broadcast(plan) if len(sizes) <= 10_000 else plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rich = rich.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    ahead = rich.groupBy("si", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("s"))
    ahead = ahead.select("si", "bucket", (F.sum("s").over(Window.partitionBy("si").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("ahead"))
    inside = Window.partitionBy("si", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rich.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(inside)).join(ahead, ["si", "bucket"])
    placed = placed.withColumn("back", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    placed = stash(placed.select("doc_id", "code", "size", "source_size", "target", "si", "source", (F.col("ahead") + F.col("upto") - F.col("size") * F.col("back")).alias("start")), "mix-placed")

    long = F.lit(how.block_words)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / long), F.floor((F.col("start") + F.col("size") - 1) / long))))
    begin = F.greatest(F.col("start"), F.col("block") * long)
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * long) - begin
    parts = parts.select("si", "block", "source", (begin - F.col("block") * long).alias("at"), "doc_id", "code", (begin - F.col("start")).alias("skip"), part.alias("words"), "start")
    # Slots grow with the input, though the plan's estimate of them is small: neither side is to be broadcast.
    rows = slots.hint("merge").join(parts, ["si", "block"]).select("shard", "slot", "si", "source", "block", "at", "doc_id", "code", "skip", "words", "start")
    return rows, placed


def filled(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each slot of a mix of ``docs``: shard, slot, source, block, text (its words, joined by spaces)."""
    ranges = rows.select("doc_id", "code", "skip", "words").distinct().groupBy("doc_id", "code").agg(F.collect_list(F.struct("skip", "words")).alias("ranges"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("code"), "text").dropDuplicates(["doc_id", "code"])
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["code"] == b["code"])
    cut = lambda w: F.transform("ranges", lambda r: F.struct(r["skip"].alias("skip"), r["words"].alias("words"), F.array_join(F.slice(w, r["skip"].cast("int") + 1, r["words"].cast("int")), " ").alias("piece")))
    # The words are an element of an array, so that they are found once for each text, not for each range.
    pieces = ranges.join(texts, same(ranges, texts)).select(ranges["doc_id"], ranges["code"], F.explode(F.flatten(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), cut))).alias("x"))
    pieces = pieces.select("doc_id", "code", "x.skip", "x.words", "x.piece")
    whole = rows.join(pieces, same(rows, pieces) & (rows["skip"] == pieces["skip"]) & (rows["words"] == pieces["words"])).select("shard", "slot", "source", "block", "at", "piece")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ")
    return whole.groupBy("shard", "slot", "source", "block").agg(text.alias("text"))


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target (its source's), taken (words in the mix)."""
    rows, placed = mixture(docs, how)
    taken = stash(rows, "mix").groupBy("si", "start").agg(F.sum("words").alias("taken"))
    full = placed.join(taken, (placed["si"] == taken["si"]) & (placed["start"] == taken["start"]) & (placed["size"] > 0), "left")
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
