"""Lines that repeat, exactly or within one edit, native DataFrame operations throughout.

A line with a word in it goes if the same line first occurs earlier, in the order of (doc_id, line number); so does a line of at least
``min_chars`` characters if a line of at least that length within edit distance one does (in shorter lines a character is too much of
what they say). Lines without a word always stay.

Method (threshold 1, so two segments): of two lines within one edit, one half is the same. A line of length n is indexed by both
halves under its length, and probes the indexes of the lengths n and n - 1 (a pair meets under the shorter one's length, whose halves
it is cut by). Equal keys are candidates, verified by a banded bit-parallel automaton: for each number of errors a bit mask over the
diagonals -1, 0, 1, moved on by one character at a time.

Skew: exact copies are summed up before anything is dealt out by line. A half that more than ``hot`` distinct lines share isn't
paired up: the other half is cut into ``fan`` finer segments, and only lines that agree on all but one of these meet, and so on
down to single characters. Lines that are the same but for one character are all within one edit, so there each is tied to the
earliest alone; and a line with a character more is looked up without it, by its hash.

Defined results: null and empty texts have no lines that count; rows that repeat an id are the same document (their equal lines
at equal numbers are one occurrence); null ids come first in the order; one output row for each input row. Lines are the same if two
64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarion.llm.common import WORD, fresh_names, stash


@dataclass(frozen=True)
class Lines:
    min_chars: int = 30
    hot: int = 64
    fan: int = 8
    broadcast_bytes: int = 32 << 20


def _code(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    parts = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    parts = parts.where(F.col("line").rlike(WORD)).withColumn("n", F.char_length("line"))
    return parts.select("doc_id", "pos", "line", "n", _code(F.col("line")).alias("h"))


def _key(line: Column, n: Column, late: Column, cuts: Column, part: Column) -> Column:
    """Hash of a line without its ``part``-th of ``cuts`` segments; ``late`` is its length minus ``n``, which the cuts are made for."""
    begin = F.floor(part * n / cuts).cast("int")
    end = F.floor((part + 1) * n / cuts).cast("int")
    return F.xxhash64(n, cuts, part, F.substring(line, F.lit(1), begin), F.substring(line, end + late + 1, n + late))


def _probes(lines: DataFrame, how: Lines) -> DataFrame:
    """(h, key, n, late, cuts, part): both halves, under a line's own length and the next shorter one."""
    spots = F.array(*[F.struct(F.lit(d).alias("late"), F.lit(p).alias("part")) for d in (0, 1) for p in (0, 1)])
    rows = lines.select("h", "line", "n", F.explode(spots).alias("x")).select("h", "line", (F.col("n") - F.col("x.late")).alias("n"), "x.late", "x.part").where(F.col("n") >= how.min_chars)
    cuts = F.lit(2)
    return rows.select("h", _key(F.col("line"), F.col("n"), F.col("late"), cuts, F.col("part")).alias("key"), "n", "late", cuts.alias("cuts"), "part")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two strings are within one edit: bit-parallel over the three diagonals, one step for each character of ``a``."""
    n, m = F.char_length(a), F.char_length(b)
    at = lambda s, i: F.substring(s, 4 * i - 3, F.lit(4))

    def step(r: Column, i: Column) -> Column:
        # Bit 0, 1, 2: diagonal -1, 0, +1. r.e0: reachable without an error, r.e1: with at most one.
        same = lambda d: at(r["x"], i) == at(r["y"], i + d)
        equal = F.when((i > 1) & same(-1), 1).otherwise(0).bitwiseOR(F.when((i <= r["m"]) & same(0), 2).otherwise(0)).bitwiseOR(F.when((i < r["m"]) & same(1), 4).otherwise(0))

        def move(eq: Column) -> Column:
            e0 = r["e0"].bitwiseAND(eq)
            e1 = r["e1"].bitwiseAND(eq).bitwiseOR(r["e0"]).bitwiseOR(F.shiftright(r["e0"], 1)).bitwiseOR(F.shiftleft(e0, 1)).bitwiseAND(F.lit(7))
            return F.struct(e0.alias("e0"), e1.alias("e1"), r["x"].alias("x"), r["y"].alias("y"), r["m"].alias("m"))

        return F.element_at(F.transform(F.array(equal), move), 1)  # binds ``equal``, which is then worked out once

    # The state holds both strings, four bytes a character: encoded once, read in constant time.
    start = F.struct(F.lit(2).alias("e0"), F.lit(6).alias("e1"), F.encode(a, "UTF-32").alias("x"), F.encode(b, "UTF-32").alias("y"), m.alias("m"))
    end = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda r: r["e1"])
    hit = end.bitwiseAND(F.when(m < n, 1).when(m == n, 2).otherwise(4)) != 0
    return F.when(F.abs(n - m) > 1, False).when((n == 0) | (m == 0), True).otherwise(hit)


def unequal_middles(pairs: DataFrame, a: str, b: str, cuts: int = 16) -> DataFrame:
    """``pairs`` with columns x and y: two strings without equal beginnings and ends, found by comparing whole parts at ``cuts`` cuts.
    Distances stay what they are. Each step is a column of its own, so that no expression is spelt out twice in the plan."""
    n, m = F.char_length(a), F.char_length(b)
    spot = lambda k: F.floor(F.col("least") * k / cuts).cast("int")
    head = [F.when(F.substring(a, F.lit(1), spot(k)) == F.substring(b, F.lit(1), spot(k)), spot(k)).otherwise(0) for k in range(1, cuts)]
    foot = [F.when(F.substring(a, F.col("n") - spot(k) + 1, spot(k)) == F.substring(b, F.col("m") - spot(k) + 1, spot(k)), spot(k)).otherwise(0) for k in range(1, cuts)]
    out = pairs.withColumns({"n": n, "m": m, "least": F.least(n, m)})
    out = out.withColumns({"lead": F.greatest(F.lit(0), *head), "foot": F.greatest(F.lit(0), *foot)})
    out = out.withColumn("foot", F.least(F.col("foot"), F.col("least") - F.col("lead")))
    middle = lambda c, size: F.substring(c, F.col("lead") + 1, F.col(size) - F.col("lead") - F.col("foot"))
    return out.withColumns({"x": middle(F.col(a), "n"), "y": middle(F.col(b), "m")}).drop("n", "m", "least", "lead", "foot")


def _links(base: DataFrame, firsts: DataFrame, how: Lines) -> DataFrame:
    """(h) of the lines that have an earlier line within one edit."""
    lines = _lines(base).where(F.col("n") >= how.min_chars)
    # Halves that two distinct lines share: from the least and the greatest line code of each, so copies cost nothing.
    live = _probes(lines, how).groupBy("key").agg(F.min("h.a").alias("lo"), F.max("h.a").alias("hi")).where("lo <> hi").select("key")
    open_ = stash(_probes(lines, how).join(live, "key", "left_semi").distinct(), "line-cands")
    wanted = stash(open_.select("h").distinct().join(firsts, "h").select("h", "first"), "line-wanted")
    size = wanted.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("first.doc_id").cast("string")), F.lit(0)) + 48), F.lit(0))).first()[0]
    place = [lines["h"] == wanted["h"], lines["doc_id"].eqNullSafe(wanted["first.doc_id"]), lines["pos"] == wanted["first.pos"]]
    texts = stash(lines.join(F.broadcast(wanted) if size <= how.broadcast_bytes else wanted, place).select(lines["h"], "first", "line").dropDuplicates(["h"]), "line-texts")
    pairs = None
    while True:
        sizes = open_.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("cuts") < F.col("n")).alias("deeper")).where("size > 1")
        sized = stash(open_.join(sizes, "key"), "line-sized")
        hot = F.col("size") > how.hot
        cold = sized.where(~hot).select("key", "h")
        found = cold.join(cold.select("key", F.col("h").alias("g")), "key").where("h < g").select("h", "g").union(_finest(sized.where(hot & ~F.col("deeper")), texts))
        pairs = found if pairs is None else pairs.union(found)
        rest = sized.where(hot & F.col("deeper")).select("h", "n", "late", "cuts", "part")
        if not rest.head(1):
            break
        finer = rest.join(texts.select("h", "line"), "h").select("h", "line", "n", "late", (F.col("cuts") * how.fan).alias("cuts"), F.explode(F.sequence(F.col("part") * how.fan, F.col("part") * how.fan + how.fan - 1)).alias("part"))
        finer = finer.select("h", _key(F.col("line"), F.col("n"), F.col("late"), F.col("cuts"), F.col("part")).alias("key"), "n", "late", "cuts", "part")
        open_ = stash(finer.distinct(), "line-cands")
    pairs = stash(pairs.distinct(), "line-pairs")
    a, b = (texts.select(F.col("h").alias(h), F.col("first").alias(f"{h}_first"), F.col("line").alias(f"{h}_line")) for h in ("h", "g"))
    linked = pairs.join(a, "h").join(b, "g")
    longer = F.greatest(F.char_length("h_line"), F.char_length("g_line"))
    spread = 4 * base.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: dealt out by pair, not by size
    middles = unequal_middles(linked.repartition(spread, "h", "g"), "h_line", "g_line").select("h", "g", "h_first", "g_first", "x", "y", longer.alias("n"))
    middles = stash(middles, "line-middles")
    # What a single edit leaves unequal at sixteen cuts is an eighth of the line and a little.
    middles = middles.where((F.greatest(F.char_length("x"), F.char_length("y")) <= F.col("n") / 8 + 3) & (F.abs(F.char_length("x") - F.char_length("y")) <= 1))
    linked = middles.where(within_one_edit(F.col("x"), F.col("y")))
    late = F.when(F.col("h_first") > F.col("g_first"), F.col("h")).otherwise(F.col("g"))
    return linked.select(late.alias("h")).distinct()


def _finest(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, g) for groups of lines that are the same but for one character (``late`` 0) or two beside each other (``late`` 1): of the former
    each with the earliest, of the latter each with the lines that one character less makes it."""
    known = groups.join(texts, "h")
    equal = known.where("late = 0")
    least = equal.groupBy("key").agg(F.min(F.struct("first", "h")).alias("least")).select("key", F.col("least.h").alias("g"))
    begin = F.floor(F.col("part") * F.col("n") / F.col("cuts")).cast("int")
    without = lambda k: F.concat(F.substring("line", F.lit(1), begin + k), F.substring("line", begin + k + 2, F.col("n") + 1))
    less = known.where("late = 1").select("h", F.explode(F.array(*[_code(without(k)) for k in (0, 1)])).alias("g"))
    return equal.join(least, "key").where("h <> g").select("h", "g").union(less.join(texts.select(F.col("h").alias("g")), "g").select("h", "g"))


def dropped_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """(doc_id, dropped): the numbers, from 0, of each document's lines that go; documents that lose none are left out."""
    base = docs.select("doc_id", "text")
    lines = _lines(base)
    firsts = stash(lines.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies")), "line-firsts")
    near = stash(_links(base, firsts, how), "line-near")
    known = firsts.join(near.withColumn("near", F.lit(True)), "h", "left").where("copies > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("doc_id", "pos", "h").join(known, "h").where(F.col("near") | ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_report(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined)."""
    gone = dropped_lines(docs, how).withColumnRenamed("doc_id", "id")
    thin = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.col("text").isNull().alias("none"))
    full = thin.join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    n = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    return full.select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), n.alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def without_repeats(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """``docs`` without the lines that go; a document that is left without a word goes too. Columns as in ``docs``, ``n_chars`` kept true."""
    ours = fresh_names(docs, ["id", "dropped", "kept"])
    gone = dropped_lines(docs, how).toDF(*ours[:2])
    full = docs.join(gone, docs["doc_id"].eqNullSafe(gone[ours[0]]), "left")
    drops, kept = F.col(ours[1]), F.col(ours[2])
    left = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda x, i: ~F.array_contains(drops, i)), "\n")
    out = full.withColumn(ours[2], F.when(drops.isNull(), docs["text"]).otherwise(left)).where(drops.isNull() | kept.rlike(WORD))
    new = {"text": kept, "n_chars": F.char_length(kept).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
