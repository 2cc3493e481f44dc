"""Quality scores from preference pairs (Bradley-Terry), cut at a score quantile.

Method: a document of quality 1 is preferred to one of quality 0. A linear score over text features (shares of kinds of characters, of
repeated words and lines, lengths, how far the text compresses, and hashed word n-grams) is learnt by logistic loss on the feature
differences of such pairs (Newton steps with an L2 term, a stronger one for n-grams), so only the ranking of documents matters. The cut
is the quantile of the training scores at the share of label 0; scores are mapped to (0, 1) so that the cut lies at ``threshold``.

The fit uses a bounded sample: ``max_labelled`` labelled ids, those of the smallest hashes, one text of each, and ``max_pairs`` pairs;
every document is scored. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text scores as a text without words; null labels and labels without a document are ignored,
of labels that contradict each other the smaller counts, of texts of one labelled id the one of the smallest hash; with labels of one kind only, or none, every score is the share of label 1
among them (0.5 if none). One output row for each row, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarion.llm.common import is_held_out, mix64, word_codes, WordCodes

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


@dataclass(frozen=True)
class Fit:
    max_labelled: int = 20_000
    max_pairs: int = 200_000
    penalty: float = 1e-3
    gram_penalty: float = 3e-2
    steps: int = 25
    threshold: float = 0.3
    seed: int = 5


N_GRAMS = 64


def grams(words: list[bytes], cache: WordCodes) -> np.ndarray:
    """Words and pairs of words, hashed to signed sums, as the square root of their share of the text."""
    codes = word_codes(words, cache)
    every = np.concatenate([mix64(codes), mix64(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])])
    sums = np.bincount((every & np.uint64(N_GRAMS - 1)).astype(np.int64), np.where(every >> np.uint64(63), 1.0, -1.0), N_GRAMS)
    return np.sign(sums) * np.sqrt(np.abs(sums) / len(every))


def features(text: str | None, press: zstandard.ZstdCompressor, cache: WordCodes) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * N_FEATURES
    count = lambda kept: size - len(raw.translate(None, kept))
    letters = count(_LETTERS)
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    ratio = len(press.compress(raw)) / size
    usual = 0.36 + 6.2 / max(np.sqrt(size), 8.0)  # what prose of this length shrinks to
    shares = [
        (size - letters - (n - 1)) / size,
        count(_UPPER) / size,
        count(_DIGITS) / size,
        count(b"#*$%&<>") / size,
        count(b"|") / size,
        count(b"!?") / size,
        count(b".,;:") / size,
        count(b"\"'()[]{}=/\\_+-@~^`") / size,
        same / n,
        1 - distinct / n,
        1 - len(set(lines)) / len(lines),
        sum(w.isdigit() for w in words) / n,
    ]
    flat = [x for v in shares for x in (v, min(1.0, 20 * v))]
    logs = np.log1p([n, size / n, n / len(lines), max(map(len, words))])
    gap = ratio - usual
    return [*flat, *logs, logs[0] ** 2 / 10, float(n < 5), float(n < 20), gap, max(0.0, -gap - 0.05), max(0.0, gap - 0.1), 1.0, *grams([w.lower() for w in words], cache)]


N_FEATURES = len(features("a b", zstandard.ZstdCompressor(), WordCodes()))


def fit(x: np.ndarray, y: np.ndarray, how: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, cut) from features and labels of both kinds."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(how.seed)
    n = min(how.max_pairs, len(good) * len(bad))
    a, b = rng.choice(good, n), rng.choice(bad, n)
    penalty = np.full(x.shape[1], how.penalty)
    penalty[-N_GRAMS:] = how.gram_penalty
    w = np.zeros(x.shape[1])
    for _ in range(how.steps):
        slope, curve = penalty * w, np.diag(penalty)
        for k in range(0, n, 20_000):  # differences of some pairs at a time
            d = z[a[k : k + 20_000]] - z[b[k : k + 20_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            slope = slope + d.T @ (p - 1) / n
            curve = curve + (d * (p * (1 - p))[:, None]).T @ d / n
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return mean, scale, w, float(np.quantile(z @ w, len(bad) / len(y)))


def quality_scores(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted; learnt from ``labels(doc_id, quality)``."""
    base = docs.select("doc_id", "text")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.where(~is_held_out(F.col("doc_id"), 0))
    chosen = marks.withColumn("h", F.xxhash64(F.lit(how.seed), "doc_id")).orderBy("h", "doc_id").limit(how.max_labelled).drop("h")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, cache = zstandard.ZstdCompressor(level=3), WordCodes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("code"), pa.array([features(t.as_py(), press, cache) for t in b.column("text")], pa.list_(pa.float64()))], ["doc_id", "quality", "code", "x"])

    texts = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("code"), "text")  # at most max_labelled ids
    found = texts.mapInArrow(gather, f"doc_id {kind}, quality int, code long, x array<double>")
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "code").alias("y")).select("y.*")
    rows = sorted((r["quality"], tuple(r["x"])) for r in found.collect())
    y = np.array([r[0] for r in rows])
    model = fit(np.array([r[1] for r in rows]), y, how) if len(set(y.tolist())) == 2 else None
    flat = float(y.mean()) if len(y) else 0.5
    shift = np.log(how.threshold / (1 - how.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, cache = zstandard.ZstdCompressor(level=3), WordCodes()
        for b in batches:
            if model is None or not b.num_rows:
                score = np.full(b.num_rows, flat)
            else:
                mean, scale, w, cut = model
                x = np.array([features(t.as_py(), press, cache) for t in b.column("text")])
                score = 1 / (1 + np.exp(-np.clip(np.clip((x - mean) / scale, -8, 8) @ w - cut + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = base.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))
