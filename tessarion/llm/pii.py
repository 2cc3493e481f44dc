"""Personal data in texts: shapes of four kinds, and contexts learnt from what the shapes find.

Method: matches of the four base expressions are seeds. The words round a seed form lexical patterns (the two words before it; the word
before and the word after), and every other identifier-like piece of text is a candidate instance of the patterns round it: a
white-space-delimited token with a digit or an at sign, or a run of digit groups joined by spaces, hyphens, dots, slashes or brackets. Each
candidate has a shape (its digits, letters and signs, runs of digits and of letters as one). Spark scores the graph of patterns,
instances and shapes in rounds: a pattern's confidence for a kind is the sum of the scores of its distinct instances over their number,
candidates of every shape included, plus a smoothing count; an instance's score is the noisy-or of its patterns' confidences, seeds
staying at one; and a shape's confidence is the like share among the distinct instances of that shape, wherever they stand. A
candidate beside a pattern of high confidence and enough support is a new span, unless its shape is one that hardly ever is of the kind.

Scale: the texts are read once, into a table of base spans and candidates; the graph holds distinct (pattern, instance) pairs,
aggregated before they are dealt out, and all rounds are joins and sums on it.

Defined results: null or empty texts have no spans; one output row for each input row, repeated or null ids included; a pattern's words
are the forty characters of a word that are nearest to the span; spans found by contexts have at least ``min_chars`` characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarion.llm.common import stash

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either begins a match or leads nowhere from any of its digits: possessive, so that each is read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_GROUPS = re.compile(r"[(+]?(?<![0-9])[0-9]++(?:[().\x20/-]{1,2}+[0-9]++)++")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    smoothing: float = 1.0
    min_support: int = 3
    min_confidence: float = 0.6
    min_shape: float = 0.1
    min_chars: int = 5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from the at signs outward: what stands before one can only begin where its run of local characters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base expressions, by kind and then start."""
    found = [(0, s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def shape(token: str) -> str:
    """Runs of digits as 0, of letters as a, the first forty signs and runs."""
    return _RUNS.sub(lambda m: "0" if m[0][0].isdigit() else "a", token)[:40]


class Words:
    """A text's white-space-delimited tokens, and what stands round a span."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.starts = [s for s, _ in self.tokens]

    def _word(self, s: int, e: int, last: bool) -> str:
        piece = self.text[max(s, e - 60) : e] if last else self.text[s : min(e, s + 60)]
        piece = _DIGIT.sub("0", piece.lower().strip(".,;:!?\"'()[]"))
        return piece[-40:] if last else piece[:40]

    def patterns(self, start: int, end: int) -> list[str]:
        """The lexical patterns round a span: L (two words before), M (a word before, a word after). What is left of the span's own
        token before it counts as a word."""
        i, j = bisect_right(self.starts, start) - 1, bisect_left(self.starts, end)
        before = [(self.starts[i], start)] if self.starts[i] < start else []
        before = [*self.tokens[max(0, i - 2 + len(before)) : i], *before]
        before = [self._word(s, e, True) for s, e in before]
        out = []
        if before:
            out.append("L " + " ".join(before))
            if j < len(self.tokens) and (after := self._word(*self.tokens[j], False)):
                out.append(f"M {before[-1]} _ {after}")
        return out

    def candidates(self, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Digit groups that hold a space, and other tokens with a digit or an at sign, outer punctuation cut, that touch no taken span."""
        out: list[tuple[int, int]] = []
        groups = [(m.start(), m.end()) for m in _GROUPS.finditer(self.text) if " " in m[0]]
        held = [(s, e) for s, e in groups if not _touches(taken, s, e)]
        out += held
        text = self.text
        for s, e in self.tokens:
            if not _MARK.search(text, s, e):
                continue
            while s < e and text[s] in "\"'<[{,;:.!?=":
                s += 1
            while e > s and text[e - 1] in "\"'>]},;:.!?=":
                e -= 1
            if s < e and not _touches(taken, s, e) and not _touches(held, s, e):
                out.append((s, e))
        return sorted(out)


def _touches(spans: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether [s, e) meets one of ``spans``, sorted, whose ends ascend too."""
    k = bisect_left(spans, (e, -1))
    return k > 0 and spans[k - 1][1] > s


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, sorted and apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_NODE = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("shape", pa.string()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
_NODE_SQL = "array<struct<k:int,s:int,e:int,shape:string,instance:long,patterns:array<string>>>"


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, nodes, digests = [], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                spans.append([{"k": k, "s": s, "e": e} for k, s, e in base])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                own = []
                if _MARK.search(text):
                    words = Words(text)
                    for k, s, e in [*base, *((-1, s, e) for s, e in words.candidates(merged([(s, e) for _, s, e in base])))]:
                        token = text[s:e].lower()
                        code = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)
                        own.append({"k": k, "s": s, "e": e, "shape": shape(token), "instance": code, "patterns": words.patterns(s, e)})
                nodes.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(spans, pa.list_(_SPAN)), pa.array(digests, pa.string()), pa.array(nodes, pa.list_(_NODE))], ["doc_id", "rid", "base", "base_sha256", "nodes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, base array<struct<k:int,s:int,e:int>>, base_sha256 string, nodes {_NODE_SQL}")


def learn(nodes: DataFrame, how: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence, support) of the patterns that pass, and (shape, kind) of the shapes that do, from
    ``nodes(k, shape, instance, patterns)``."""
    edges = nodes.select("k", "shape", "instance", F.explode("patterns").alias("pattern"))
    edges = stash(edges.groupBy("pattern", "instance", "shape").agg(F.max("k").alias("k")), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    shapes = edges.groupBy("shape").agg(F.count_distinct("instance").alias("n"))
    seeds = edges.where("k >= 0").select("instance", "shape", F.col("k").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for _ in range(how.rounds):
        scored = edges.join(scores.select("instance", "kind", "score"), "instance")
        conf = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum((F.col("score") >= how.min_confidence).cast("long")).alias("support"))
        conf = conf.join(totals, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + how.smoothing)).alias("confidence"), "support")
        conf = stash(conf.where((F.col("support") >= how.min_support) & (F.col("confidence") >= how.min_confidence)), "pii-patterns")
        gain = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        found = edges.where("k < 0").join(conf, "pattern").groupBy("instance", "shape", "kind").agg((1 - F.exp(gain)).alias("score"))
        every = seeds.unionByName(found.select("instance", "shape", "kind", "score")).groupBy("instance", "shape", "kind").agg(F.max("score").alias("score"))
        usual = every.groupBy("shape", "kind").agg(F.sum("score").alias("sum")).join(shapes, "shape")
        usual = stash(usual.where(F.col("sum") >= how.min_shape * (F.col("n") + how.smoothing)).select("shape", "kind"), "pii-shapes")
        scores = stash(every.join(usual, ["shape", "kind"], "left_semi"), "pii-scores")
    return conf, usual


def personal_data(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """For each row (doc_id, text): base counts and digest, and all spans, discovered ones included."""
    seen = stash(_scan(docs), "pii-scan")
    nodes = seen.select("rid", F.explode("nodes").alias("n")).select("rid", "n.*")
    good, usual = learn(nodes.drop("rid", "s", "e"), how)
    fresh = nodes.where((F.col("k") < 0) & (F.col("e") - F.col("s") >= how.min_chars)).select("rid", "s", "e", "shape", F.explode("patterns").alias("pattern"))
    best = fresh.join(good, "pattern").join(usual, ["shape", "kind"], "left_semi")
    best = best.groupBy("rid", "s", "e").agg(F.max_by(F.col("kind"), F.struct("confidence", -F.col("kind"))).alias("k"))
    more = best.groupBy("rid").agg(F.collect_set(F.struct("k", "s", "e")).alias("more"))
    both = seen.select("doc_id", "rid", "base", "base_sha256").join(more, "rid", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>"))))
    shown = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def of_kind(i: int) -> Callable[[Column], Column]:
        return lambda x: x["k"] == i  # one parameter: a second one would be the index

    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return both.select("doc_id", *counts, "base_sha256", shown.alias("spans"), F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_discovered"))
