import math
from collections import Counter

import numpy as np
import pytest

from tessarion.llm import bradley_terry, mixing, ngram_lm
from tessarion.llm.common import components, pack, unpack

import zlib


def brute_lm(rows, order):
    """doc index -> (n_tokens, n_known, N, base, score), straight from the definitions."""
    texts = [[*(t or "").encode().lower().split(), 0] for _, t in rows]
    train = [x for (i, _), x in zip(rows, texts) if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c1 = Counter(w for x in train for w in x)
    n, v = sum(c1.values()), len(c1)
    grams = {k: Counter() for k in range(2, order + 1)}
    for x in train:
        s = [1, *x]
        for k in grams:
            grams[k].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    total, kinds, disc = {}, {}, {}
    for k, g in grams.items():
        total[k], kinds[k] = Counter(), Counter()
        for h, c in g.items():
            total[k][h[:-1]] += c
            kinds[k][h[:-1]] += 1
        n1, n2 = sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())
        disc[k] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    out = []
    for x in texts:
        s, base, score = [1, *x], 0.0, 0.0
        for i in range(1, len(s)):
            p = (c1[s[i]] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    break
                h = tuple(s[i - k + 1 : i])
                if total[k][h]:
                    c = grams[k][h + (s[i],)]
                    p = (c - disc[k] if c else 0) / total[k][h] + disc[k] * kinds[k][h] / total[k][h] * p
            score += math.log10(p)
        out.append((len(x), sum(c1[w] > 0 for w in x), n, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize("order,how", [(2, {}), (2, {"block_tokens": 3000, "bucket_bytes": 4000}), (2, {"block_tokens": 2000, "bucket_bytes": 2000, "max_hot": 3}), (3, {"block_tokens": 5000, "bucket_bytes": 20000})])
def test_scores_equal_the_definition(spark, rows_of, order, how):
    rows = rows_of("documents", 150) + [(1001, None), (1002, ""), (None, "the the THE"), (3, "the of and"), (3, "the of and")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = ngram_lm.lm_scores(df, ngram_lm.Lm(order=order, **how)).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_lm(rows, order)))
    have = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert have == want


def test_lm_of_a_small_corpus_against_the_definition(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b", "b c a", "c", "a a b b", "b a c a"] * 2)]
    probe = [(100 + k, w) for k, w in enumerate(["", "a", "b", "c", "zz"])]
    ids = [i for i in range(200, 4000) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    df = spark.createDataFrame([*rows, *((i, t) for i, (_, t) in zip(ids, probe))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_lm.lm_scores(df).collect()}
    want = brute_lm([*rows, *((i, t) for i, (_, t) in zip(ids, probe))], 2)
    for i, w in zip(ids, want[len(rows) :]):
        assert abs(got[i]["score"] - w[4]) < 1e-5 and got[i]["held_out"]
    assert ngram_lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_text_scores_above_base_where_it_was_seen(spark):
    held = next(i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 1)
    seen = next(i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 2)
    text = " ".join(f"w{k}" for k in range(200))
    r = {x["doc_id"]: x for x in ngram_lm.lm_scores(spark.createDataFrame([(held, text), (seen, text)], "doc_id long, text string")).collect()}
    assert r[held]["score"] > r[held]["base_score"] + 50


def test_pairwise_ranking_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = bradley_terry.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_the_fit_minimises_the_pairwise_loss():
    rng = np.random.default_rng(2)
    n = bradley_terry.N_FEATURES
    x = rng.normal(size=(400, n))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=400) > 0).astype(int)
    how = bradley_terry.Fit(max_pairs=3000)
    mean, scale, w, cut = bradley_terry.fit(x, y, how)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(how.seed)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), 3000), draw.choice(np.flatnonzero(y == 0), 3000)))

    def loss(v):
        fit = sum(math.log1p(math.exp(-float((z[a] - z[b]) @ v))) for a, b in pairs) / len(pairs)
        grams = bradley_terry.N_GRAMS
        return fit + how.penalty / 2 * float((v[:-grams] ** 2).sum()) + how.gram_penalty / 2 * float((v[-grams:] ** 2).sum())

    least = loss(w)
    for _ in range(20):  # no step in any direction goes lower
        step = rng.normal(size=n) * 0.02
        assert loss(w + step) > least
    assert w[0] > 0 > w[3] and abs((z @ w < cut).mean() - (y == 0).mean()) < 0.01


def test_ranking_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.1), (3, "x y z", 0.2), (3, "x y z", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None), (99, 0)], "doc_id long, quality int")
    for labels in (none, one):
        rows = bradley_terry.quality_scores(docs, labels).collect()
        assert len(rows) == 5 and len({r["score"] for r in rows}) == 1
    assert bradley_terry.quality_scores(docs.limit(0), one).count() == 0


def brute_targets(sizes, weights, most):
    out = [sum(sizes) * w / sum(weights) for w in weights]
    while True:
        over = [i for i, s in enumerate(sizes) if out[i] > most * s + 1e-9]
        if not over:
            return out
        excess = sum(out[i] - most * sizes[i] for i in over)
        for i in over:
            out[i] = most * sizes[i]
        free = [i for i, s in enumerate(sizes) if out[i] < most * s - 1e-9]
        for i in free:
            out[i] += excess * weights[i] / sum(weights[j] for j in free)


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 100, 3, 1000], [0, 10, 10], [7], [0, 0], [1, 1, 1, 1, 10_000]])
def test_targets(sizes):
    w = [1.0 + i % 3 for i in range(len(sizes))]
    assert np.allclose(mixing.targets(sizes, w, 3.0), brute_targets(sizes, w, 3.0))


def test_shard_counts_meet_quotas():
    quota = np.array([1000, 0, 17, 333_333])
    c = mixing.shard_counts(quota, 16, 3)
    assert (c.sum(axis=0) == quota).all() and c.min() >= 0 and np.ptp(c.sum(axis=1)) <= 1


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), 8).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_mix(spark, rows_of):
    texts = [t for _, t in rows_of("documents", 200)]
    rows = [(k, t, ["a", "b", None, "c"][min(3, k % 7)]) for k, t in enumerate(texts)] + [(900, None, "a"), (901, "", None), (902, "w", "d"), (902, "w", "d"), (None, "x y", "b")]
    df = spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, size int")
    first, again = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    assert Counter(first) == Counter(again) and len(first) == len(rows)
    by = {}
    for r in first:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert abs(sum(t for _, t in by) - sum(r["size"] for r in first)) < 1e-6
    for (size, target), taken in by.items():
        if size > 500:
            assert abs(sum(taken) - target) <= 3 * 64 + 0.01 * target
    assert mixing.mix(df.limit(0)).count() == 0


def test_another_seed_makes_another_mix(spark, rows_of):
    texts = [t for _, t in rows_of("documents", 200)]
    df = spark.createDataFrame([(k, t, ["a", "b", "c"][k % 3]) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    one, two = (sorted(mixing.mix(df, mixing.Mix(seed=s)).collect()) for s in (1, 2))
    assert [r["taken"] for r in one] != [r["taken"] for r in two]
    for rows in (one, two):
        for target in {r["target"] for r in rows}:
            assert abs(sum(r["taken"] for r in rows if r["target"] == target) - target) <= 2 * 64 + 0.01 * target
    draws = [mixing.shard_counts(np.array([500, 1000, 1500]), 8, s) for s in (1, 2)]
    assert (draws[0] != draws[1]).any() and all((d.sum(axis=0) == [500, 1000, 1500]).all() and np.ptp(d.sum(axis=1)) <= 1 for d in draws)


def test_rows_that_repeat_are_documents_of_their_own(spark):
    words = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, words, "a")] * 30 + [(k, words + str(k), "b") for k in range(30)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 60 and all(0 <= r["taken"] <= 3 * r["size"] for r in got) and sum(r["doc_id"] is None for r in got) == 30


def test_the_mix_itself(spark, rows_of):
    texts = [t for _, t in rows_of("documents", 60)]
    rows = [(k, t, ["a", "b", None][k % 3]) for k, t in enumerate(texts)] + [(0, "another text of the same id", "a"), *[(950, " ".join(f"w{j}" for j in range(99)), "a")] * 3, (None, "x\ty  z", "b"), (901, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = mixing.Mix(shards=5)
    mixed, placed = mixing.mixture(df, how)
    got = mixed.collect()
    slots = {(r["shard"], r["slot"]): (r["si"], r["block"]) for r in got}
    blocks = {}
    for r in got:
        assert slots[r["shard"], r["slot"]] == (r["si"], r["block"])
        blocks.setdefault((r["si"], r["block"]), set()).add((r["at"], r["start"], r["skip"], r["words"]))
    n = Counter(s for s, _ in slots)
    assert set(slots) == {(s, k) for s in n for k in range(n[s])} and np.ptp(list(n.values())) <= 1 and len(n) == 5
    quota = np.array([sum(i == si for i, _ in slots.values()) for si in range(3)])
    want = mixing.shard_counts(quota, 5, how.seed)  # the draws decide what each shard holds
    assert all(want[s, i] == sum(k[0] == s and v[0] == i for k, v in slots.items()) for s in range(5) for i in range(3))
    order = [slots[0, k][0] for k in range(n[0])]
    assert sum(a != b for a, b in zip(order, order[1:])) > 2  # sources alternate within a shard
    for parts in blocks.values():
        at = 0
        for begin, _, _, words in sorted(parts):
            assert begin == at
            at += words
        assert at <= how.block_words
    words = {}
    for r in placed.collect():
        text = next(t for d, t, s in rows if d == r["doc_id"] and s == r["source"] and len((t or "").split()) == r["size"])
        words.setdefault(r["source"], []).append((r["start"], (text or "").split()))
    words = {s: [w for _, t in sorted(ts) for w in t] for s, ts in words.items()}
    full = mixing.filled(mixed, df).collect()
    assert len(full) == len(slots)
    for r in full:
        assert r["text"].split(" ") == words[r["source"]][64 * r["block"] : 64 * r["block"] + 64]
    assert sum(r["taken"] for r in mixing.mix(df, how).collect()) == sum(len(r["text"].split(" ")) for r in full)
    assert mixing.mixture(df.limit(0), how)[0].count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 3), (7, 7)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3, 4, 5)} == {1} and got[11] == 10 and {got[k] for k in range(100, 161)} == {100} and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pack():
    a, b = np.array([1, 2**63], np.uint64), np.zeros(0, np.uint8)
    x, y = unpack(pack(a, b))
    assert (x == a).all() and len(y) == 0
