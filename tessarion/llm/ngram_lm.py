"""Log-probabilities of texts under an n-gram model, by a weighted backoff automaton.

Model: P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); for a context h of k - 1 tokens that occurs in training,
Pk(w | h) = max(c(hw) - Dk, 0) / c(h) + Dk n(h) / c(h) * Pk-1(w | h without its first token), n(h) being the number of distinct
tokens after h and Dk = n1 / (n1 + 2 n2) the discount that the counts of order k call for. Every state of the automaton is a
context that occurs; its arcs carry log10 Pk of the tokens seen after it, its failure arc log10(Dk n(h) / c(h)) and leads to the state of
the shortened context; the root has an arc for every token. A text is read once, left to right, from the state of the text's begin;
long ones in stretches side by side, each from the state that the tokens before it lead to.

Scale: the automaton grows with the corpus, so no task holds it. Documents are packed into blocks of about ``block_tokens``
tokens. Each block asks for just its own n-grams: (context, token, training count) entries, distinct within the block and dealt
out by context into buckets that answer for about ``bucket_bytes`` of text each. A bucket adds up the counts of all blocks and answers
each block with the global counts of what it asked for; a block writes to a bucket only what it has for it. The block then builds its
part of the automaton, which holds every arc that its texts can follow, and traverses it. Contexts with too many distinct followers
for one bucket, more than a ``1 / (4 buckets)`` share, are dealt out over several buckets by follower; their totals are put together
by Spark and go to every block: a list of the ``max_hot`` greatest at most, so a context beyond it holds less than ``1 / max_hot`` of all.

Defined results: a null or empty text is the end token alone; documents of a null id are training documents; without training
tokens every token has probability 1 (N = V = 0) of the single unknown class; one row for each input row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarion.llm.common import is_held_out, lower_words, mix64, pack, stash, unpack, word_codes, WordCodes

#: Codes of the end token and of the begin, which is a context only.
END, BEGIN = np.uint64(0x656E64), np.uint64(0x626567)


@dataclass(frozen=True)
class Lm:
    order: int = 2
    block_tokens: int = 700_000
    bucket_bytes: int = 16_000_000
    max_hot: int = 65_536
    span: int = 256


def _tokenise(docs: DataFrame, how: Lm, share: int) -> DataFrame:
    """Blocks of documents: ids, lengths, flags and token codes, the number of distinct n-grams they hold, and the contexts with more than one
    in ``share`` of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        ids, held, codes, lengths, n = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(codes)
            vocab, tokens = np.unique(every, return_inverse=True)
            block = Block(vocab, tokens.astype(np.int32), np.array(lengths), np.array(held), how.order)
            many = []
            entries = 0
            for k in range(2, how.order + 1):
                g = block.grams(k)
                entries += len(g.pair_context)
                size = np.bincount(g.pair_context, minlength=len(g.contexts))
                many += [{"k": k, "code": int(g.contexts[i].view(np.int64)), "n": int(size[i])} for i in np.flatnonzero(size * share > len(g.pair_context))]
            data = pack(vocab, tokens.astype(np.int32), np.array(lengths, np.int64), np.array(held, np.uint8))
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(id_type)), pa.array([data], pa.binary()), pa.array([entries], pa.int64()), pa.array([many], pa.list_(pa.struct([("k", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])))],
                ["block", "ids", "data", "entries", "many"],
            )

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, t, h in zip(batch.column("doc_id"), batch.column("text"), batch.column("held_out")):
                words = lower_words(t.as_py())
                ids.append(i.as_py())
                held.append(h.as_py())
                codes.append(np.append(word_codes(words, cache), END).astype(np.uint64))
                lengths.append(len(words) + 1)
                n += lengths[-1]
                if n >= how.block_tokens:
                    yield flush()
                    ids, held, codes, lengths, n = [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id"), 1).alias("held_out"))
    return rows.mapInArrow(run, f"block string, ids array<{kind}>, data binary, entries long, many array<struct<k:int,code:long,n:long>>")


@dataclass
class Grams:
    """Order k of a block. By pair: its context and word code, its training count. By position: the pair and the context."""

    contexts: np.ndarray
    pair_context: np.ndarray
    pair_word: np.ndarray
    pair_count: np.ndarray
    pair_first: np.ndarray
    at: np.ndarray
    position_pair: np.ndarray


class Block:
    """The token sequences of some documents; position -1 of each is the begin."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray, order: int) -> None:
        self.vocab, self.tokens, self.lengths, self.held, self.order = vocab, tokens, lengths, held, order
        self.codes = vocab[tokens]
        self.ends = np.cumsum(lengths)
        self.inside = np.arange(len(tokens)) - np.repeat(self.ends - lengths, lengths)  # index within the document
        self.trains = np.repeat(held == 0, lengths)

    def context_codes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions that have k - 1 tokens, the begin included, before them; the codes of those contexts)."""
        at = np.flatnonzero(self.inside >= k - 2)
        code = np.zeros(len(at), np.uint64)
        for back in range(1, k):
            own = np.where(self.inside[at] >= back, self.codes[np.maximum(at - back, 0)], BEGIN)
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + own + np.uint64(k))
        return at, code

    def grams(self, k: int) -> Grams:
        at, code = self.context_codes(k)
        contexts, which = np.unique(code, return_inverse=True)
        pair = which.astype(np.int64) * len(self.vocab) + self.tokens[at]
        pairs, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        count = np.bincount(inverse[self.trains[at]], minlength=len(pairs))
        owner = pairs // len(self.vocab)
        return Grams(contexts, owner, self.vocab[pairs % len(self.vocab)] if len(pairs) else np.zeros(0, np.uint64), count, at[first], at, inverse)


def _deal(contexts: np.ndarray, spread: dict[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, number of buckets) of each context."""
    first = (mix64(contexts) % np.uint64(buckets)).astype(np.int64)
    wide = np.ones(len(contexts), np.int64)
    if spread:
        hot = np.array(sorted(spread), np.uint64)
        k = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
        same = hot[k] == contexts
        wide[same] = np.array([spread[int(h)] for h in hot])[k[same]]
    return first, wide


def _shares(g: Grams, spread: dict[int, int], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, the contexts it is asked for, the pairs it is asked for), the same for question and answer."""
    first, wide = _deal(g.contexts, spread, buckets)
    own = (first[g.pair_context] + (mix64(g.pair_word) % wide[g.pair_context].astype(np.uint64)).astype(np.int64)) % buckets
    order = np.argsort(own, kind="stable")  # pairs stay in order of their contexts
    there, begin = np.unique(own[order], return_index=True)
    for b, lo, hi in zip(there.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        yield b, np.unique(g.pair_context[order[lo:hi]]), order[lo:hi]


def _ask(blocks: DataFrame, how: Lm, spread: dict[int, dict[int, int]], buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("block"), batch.column("data")):
                block = Block(*unpack(data.as_py()), how.order)
                for k in range(2, how.order + 1):
                    g = block.grams(k)
                    out: tuple[list, list] = ([], [])
                    for b, contexts, pairs in _shares(g, spread[k], buckets):
                        sizes = np.bincount(np.searchsorted(contexts, g.pair_context[pairs]), minlength=len(contexts))
                        code = g.contexts[contexts]
                        word = mix64(g.pair_word[pairs])
                        out[0].append(b)
                        out[1].append(pack(np.diff(code, prepend=np.uint64(0)), sizes.astype(np.uint32), word.astype(np.uint32), (word >> np.uint64(32)).astype(np.uint8), g.pair_count[pairs].astype(np.uint32)))
                    n = len(out[0])
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([k] * n, pa.int32()), pa.array([name.as_py()] * n, pa.string()), pa.array(out[1], pa.binary())], ["bucket", "k", "block", "data"])

    return blocks.select("block", "data").mapInArrow(run, "bucket int, k int, block string, data binary")


_SUMS = ("n1", "n2", "types", "tokens", "texts")
_ANSWER = "bucket int, k int, block string, data binary, " + ", ".join(f"{c} long" for c in _SUMS) + ", hot array<struct<code:long,total:long,kinds:long>>"


def _answer(asked: DataFrame, spread: dict[int, dict[int, int]]) -> DataFrame:
    """Per bucket, order and block the global counts; and per bucket and order (block '') its sums, with its part of each hot context."""
    begin = int(mix64(BEGIN + np.uint64(2)))
    lists = {k: np.array(sorted(v), np.uint64) for k, v in spread.items()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, k = key[0].as_py(), key[1].as_py()
        names = table.column("block").to_pylist()
        parts = [unpack(d.as_py()) for d in table.column("data")]
        codes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        contexts, which = np.unique(np.concatenate(codes), return_inverse=True)
        owner = np.repeat(which, np.concatenate([p[1] for p in parts]))
        word = np.concatenate([p[2] for p in parts]).astype(np.uint64) | np.concatenate([p[3] for p in parts]).astype(np.uint64) << np.uint64(32)
        gram, first, inverse = np.unique(mix64(contexts[owner] + word * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True)
        count = np.zeros(len(gram), np.int64)
        np.add.at(count, inverse, np.concatenate([p[4] for p in parts]).astype(np.int64))
        total = np.zeros(len(contexts), np.int64)
        np.add.at(total, owner[first], count)
        kinds = np.bincount(owner[first][count > 0], minlength=len(contexts))
        hot = np.isin(contexts, lists[k])
        start = contexts == np.uint64(begin) if k == 2 else np.zeros(len(contexts), bool)
        sums = {"n1": int((count == 1).sum()), "n2": int((count == 2).sum()), "types": int((~hot & ~start & (total > 0)).sum()), "tokens": int(total[~start].sum()), "texts": int(total[start].sum())}
        parted = [{"code": c, "total": t, "kinds": d} for c, t, d in zip(contexts[hot].view(np.int64).tolist(), total[hot].tolist(), kinds[hot].tolist())]
        out, c0, p0 = [], 0, 0
        for p in parts:
            c1, p1 = c0 + len(p[0]), p0 + len(p[2])
            out.append(pack(total[which[c0:c1]], kinds[which[c0:c1]], count[inverse[p0:p1]]))
            c0, p0 = c1, p1
        n = len(names)
        columns = {"bucket": pa.array([bucket] * (n + 1), pa.int32()), "k": pa.array([k] * (n + 1), pa.int32()), "block": pa.array([*names, ""], pa.string()), "data": pa.array([*out, None], pa.binary())}
        columns |= {c: pa.array([None] * n + [sums[c]], pa.int64()) for c in _SUMS}
        return pa.table(columns | {"hot": pa.array([None] * n + [parted], pa.list_(pa.struct([("code", pa.int64()), ("total", pa.int64()), ("kinds", pa.int64())])))})

    return asked.groupBy("bucket", "k").applyInArrow(run, _ANSWER)


class Automaton:
    """States and arcs that a block's texts can reach. State 0 is the root; arcs are sorted by state and token."""

    def __init__(self, states: np.ndarray, tokens: np.ndarray, weight: np.ndarray, target: np.ndarray, fail: np.ndarray, fail_weight: np.ndarray) -> None:
        keys = states << 32 | tokens
        order = np.argsort(keys)
        self.keys, self.weight, self.target = keys[order], weight[order], target[order]
        self.fail, self.fail_weight = fail, fail_weight

    def traverse(self, states: np.ndarray, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights, state at the end) of stretches of tokens, each read from left to right from its state, side by side."""
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        state, total = states[order].copy(), np.zeros(len(order))
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k))  # stretches with more than k tokens come first
            at = np.arange(live)
            token = tokens[begin[:live] + k].astype(np.int64)
            while len(at):
                key = state[at] << 32 | token[at]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[arc] == key
                found = at[hit]
                total[found] += self.weight[arc[hit]]
                state[found] = self.target[arc[hit]]
                at = at[~hit]  # these take their state's failure arc and look again
                total[at] += self.fail_weight[state[at]]
                state[at] = self.fail[state[at]]
        sums, ends = np.empty(len(order)), np.empty(len(order), np.int64)
        sums[order], ends[order] = total, state
        return sums, ends


def read(automaton: Automaton, block: Block, before: np.ndarray, span: int) -> np.ndarray:
    """Each text's sum of weights. Texts are read in stretches of ``span`` tokens, side by side: the state before a token depends on the last
    tokens alone, so ``before`` has the one to begin with, and the state carried to a stretch's end must be that of the next."""
    starts = np.flatnonzero(block.inside % span == 0)
    lengths = np.minimum(span, np.diff(np.append(starts, len(block.tokens))))
    sums, ends = automaton.traverse(before[starts], block.tokens, starts, lengths)
    inner = np.flatnonzero(block.inside[starts[1:]] > 0) if len(starts) > 1 else np.zeros(0, np.int64)
    assert (ends[inner] == before[starts[inner + 1]]).all()
    return np.add.reduceat(sums, np.flatnonzero(block.inside[starts] == 0))


def build(block: Block, tables: dict[int, tuple[Grams, np.ndarray, np.ndarray, np.ndarray]], unigram: np.ndarray, discount: dict[int, float]) -> tuple[Automaton, np.ndarray]:
    """The automaton and, for each position, the state before it. ``tables[k]``: grams, and totals, kinds by context, counts by pair;
    ``unigram``: log10 P1 by vocabulary index."""
    n = len(block.tokens)
    vocab = len(block.vocab)
    below = np.zeros(n, np.int64)  # by position, the state of the longest context handled so far
    chance = 10.0 ** unigram[block.tokens]  # by position, P(token | that context)
    layers = []  # (state, token, log weight, position of an example)
    used = np.unique(block.tokens)
    example = np.zeros(vocab, np.int64)
    example[block.tokens] = np.arange(n)
    layers.append((np.zeros(len(used), np.int64), used, unigram[used], example[used]))
    states, fails, fail_weights = 1, [np.zeros(1, np.int64)], [np.zeros(1)]
    for k in range(2, block.order + 1):
        g, total, kinds, count = tables[k]
        live = np.flatnonzero(total > 0)
        number = np.zeros(len(total), np.int64)
        number[live] = states + np.arange(len(live))
        context_of = g.pair_context[g.position_pair]
        on = total[context_of] > 0
        at = g.at[on]
        ctx = context_of[on]
        back = np.zeros(len(total), np.int64)
        back[ctx] = below[at]
        rest = np.where(total > 0, discount[k] * kinds / np.maximum(total, 1), 1.0)
        fails.append(back[live])
        fail_weights.append(np.log10(np.maximum(rest[live], 1e-300)))
        seen = np.maximum(count[g.position_pair[on]] - discount[k], 0.0) * (count[g.position_pair[on]] > 0)
        chance[at] = seen / total[ctx] + rest[ctx] * chance[at]
        below[at] = number[ctx]
        own = np.flatnonzero(count > 0)
        where = g.pair_first[own]
        layers.append((number[g.pair_context[own]], block.tokens[where], np.log10(chance[where]), where))
        states += len(live)
    last = np.zeros(n, bool)
    last[block.ends - 1] = True
    after = np.append(below[1:], 0)
    after[last] = 0  # nothing follows the end
    # An arc leads to the longest state that its context and token make: of an example's next state, at most one token longer.
    level = np.concatenate([np.full(len(f), j + 1) for j, f in enumerate(fails)])
    fail = np.concatenate(fails)
    arcs: tuple[list, ...] = ([], [], [], [])
    for j, (state, token, weight, where) in enumerate(layers):
        to = after[where].copy()
        while (deep := level[to] > j + 2).any():
            to[deep] = fail[to[deep]]
        for held, column in zip(arcs, (state, token.astype(np.int64), weight, to)):
            held.append(column)
    return Automaton(*map(np.concatenate, arcs), fail, np.concatenate(fail_weights)), below


def lm_scores(docs: DataFrame, how: Lm = Lm()) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size * (how.order - 1) // how.bucket_bytes))
    blocks = stash(_tokenise(docs, how, max(1024, 8 * buckets)), "lm-blocks")
    entries = blocks.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    many = blocks.select(F.explode("many").alias("m")).groupBy("m.k", "m.code").agg(F.sum("m.n").alias("n")).where(F.col("n") * 4 * buckets > entries)
    spread: dict[int, dict[int, int]] = {k: {} for k in range(2, how.order + 1)}
    for r in many.orderBy(F.desc("n"), "k", "code").limit(how.max_hot).collect():
        spread[r["k"]][r["code"] & 0xFFFFFFFFFFFFFFFF] = max(1, min(buckets, -(-4 * r["n"] * buckets // max(1, entries))))
    answers = stash(_answer(_ask(blocks, how, spread, buckets), spread), "lm-answers")

    heads = answers.where("block = ''")
    sums = {k: dict.fromkeys(_SUMS, 0) for k in spread}
    for r in heads.groupBy("k").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect():  # one row an order
        sums[r["k"]] = r.asDict()
    parted = heads.select("k", F.explode("hot").alias("h")).groupBy("k", "h.code").agg(F.sum("h.total").alias("total"), F.sum("h.kinds").alias("kinds"))
    whole: dict[int, np.ndarray] = {}  # by order: code, total and kinds of the hot contexts, at most max_hot
    found = parted.collect()
    for k in spread:
        own = sorted((r["code"] & 0xFFFFFFFFFFFFFFFF, r["total"], r["kinds"]) for r in found if r["k"] == k)
        whole[k] = np.array(own, np.uint64).reshape(-1, 3)
    texts = sums[2]["texts"]
    start = np.uint64(mix64(BEGIN + np.uint64(2)))
    tokens, types = sums[2]["tokens"] + texts, sums[2]["types"] + int(((whole[2][:, 1] > 0) & (whole[2][:, 0] != start)).sum()) + (texts > 0)
    discount = {k: min(0.95, max(0.05, s["n1"] / (s["n1"] + 2 * s["n2"]))) if s["n1"] else 0.5 for k, s in sums.items()}
    kind = docs.schema["doc_id"].dataType

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("ids").combine_chunks().flatten()
        block = Block(*unpack(left.column("data")[0].as_py()), how.order)
        replies = {(b, k): d for b, k, d in zip(right.column("bucket").to_pylist(), right.column("k").to_pylist(), right.column("data"))}
        tables = {}
        for k in range(2, how.order + 1):
            g = block.grams(k)
            total, kinds, count = (np.zeros(n, np.int64) for n in (len(g.contexts), len(g.contexts), len(g.pair_context)))
            for b, contexts, pairs in _shares(g, spread[k], buckets):
                t, d, c = unpack(replies[b, k].as_py())
                total[contexts] = t
                kinds[contexts] = d
                count[pairs] = c
            at = np.minimum(np.searchsorted(g.contexts, whole[k][:, 0]), len(g.contexts) - 1)
            here = g.contexts[at] == whole[k][:, 0]
            total[at[here]] = whole[k][here, 1]
            kinds[at[here]] = whole[k][here, 2]
            tables[k] = (g, total, kinds, count)
        g, total, _, _ = tables[2]
        own = np.searchsorted(g.contexts, mix64(block.vocab + np.uint64(2)))
        there = (own < len(g.contexts)) & (g.contexts[np.minimum(own, len(g.contexts) - 1)] == mix64(block.vocab + np.uint64(2)))
        known = np.where(there, total[np.minimum(own, len(total) - 1)], 0)
        known[block.vocab == END] = texts
        unigram = np.log10((known + 0.5) / (tokens + 0.5 * (types + 1)))
        automaton, before = build(block, tables, unigram, discount)
        starts = block.ends - block.lengths
        out = read(automaton, block, before, how.span)
        by_doc = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(block.held == 1),
                "n_tokens": pa.array(block.lengths.astype(np.int64)),
                "n_known": pa.array(by_doc((known > 0)[block.tokens].astype(np.int64))),
                "train_tokens": pa.array([tokens] * len(ids), pa.int64()),
                "base_score": pa.array(by_doc(unigram[block.tokens])),
                "score": pa.array(out, pa.float64()),
            }
        )

    pairs = blocks.select("block", "ids", "data").groupBy("block").cogroup(answers.where("block <> ''").groupBy("block"))
    return pairs.applyInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
