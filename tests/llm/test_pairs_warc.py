import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessarion.llm import decontam, line_dedup, parity_join, warc


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def varied(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for size in (1, 3, 4, 5, 6, 9, 12, 30, 80, 200, 600):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 2, 4, 8):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = word()
                if edits == 4:
                    w = w[: max(1, len(w) * 9 // 10)]
                rows.append((n, " ".join(w)))
                n += 1
    base = [word() for _ in range(120)]
    for _ in range(90):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append((n, " ".join(w)))
        n += 1
    shared = " ".join(word() for _ in range(60))
    for _ in range(40):  # a passage that unlike documents share
        rows.append((n, shared + " " + " ".join(word() for _ in range(100))))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [parity_join.Near(), parity_join.Near(bucket_bytes=20_000, block_keys=4000, local=2, hot=6)])
def test_near_components_against_brute_force(spark, how):
    rows = varied() + [(9001, None), (9002, ""), (9003, " \n"), (None, "lone words here"), (5, "a b"), (5, "c d"), (6000, "A B"), (6001, "a b")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, component_id int").repartition(4)
    got = parity_join.near_components(df, how).collect()
    want = brute_components(rows)
    blank = Counter({(d, n, d if n == 0 else c): k for (d, n, c), k in want.items()})
    assert Counter(tuple(r) for r in got) == blank


def test_no_link_is_lost_where_keys_are_equal_by_chance(spark):
    rows = [r for r in varied(5) if r[0] % 2]
    rows += [(9000 + d, t.upper()) for d, t in rows[:60]]  # the same sets again, in other blocks
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = parity_join.near_components(df, parity_join.Near(bucket_bytes=20_000, block_keys=3000, local=3, hot=16, key_bits=13)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_what_a_key_costs_does_not_grow_with_the_ranges(spark):
    rng = random.Random(1)
    rows = [(d, " ".join(str(rng.randrange(10**6)) for _ in range(40))) for d in range(4000)]
    scan = parity_join._scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), parity_join.Near()).persist()
    nodes = scan.where("node is not null").select("node", F.struct("block", "entries").alias("home"), F.col("block").alias("last_block"))
    few, many = (parity_join._pieces(scan, nodes, parity_join.Near(), k).agg(F.sum(F.length("data"))).first()[0] for k in (1, 80))
    scan.unpersist()
    assert many < 1.25 * few  # 1.95 when each piece had the names of its nodes


def test_near_on_the_tables(spark, rows_of):
    rows = rows_of("documents", 10_000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in parity_join.near_components(df).collect()) == brute_components(rows)
    kept = parity_join.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len({c for _, _, c in brute_components(rows)})
    assert parity_join.near_components(df.limit(0)).count() == 0


def plain(text):
    return [w.strip(".,;:!?\"'()[]{}") or w for w in re.findall(r"[^ \t\n\r\v\f]+", (text or "").lower())]


def shingled(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def brute_items(docs, items, k=5, least=0.8):
    """(doc, item) by definition: the greatest weighted Jaccard similarity over every stretch whose length the similarity allows."""
    out = set()
    for item, text in items:
        own = plain(text)
        want = shingled(own, k)
        n = sum(want.values())
        for d, t in docs:
            words = plain(t)
            if not own or not set(want) & set(shingled(words, k if len(own) >= k else len(own))):
                continue
            lo, hi = (int(n * least) + k - 1, int(n / least) + k) if len(own) >= k else (len(own), len(own))
            for s in range(len(words)):
                if any(
                    (both := sum((want & (got := shingled(words[s:e], k))).values())) >= least * (n + sum(got.values()) - both) - 1e-12
                    for e in range(min(len(words), s + lo), min(len(words), s + hi) + 1)
                    if e > s
                ):
                    out.add((d, item))
                    break
    return out


def test_contaminated_documents(spark, rows_of):
    how = decontam.Radar()
    items, docs = rows_of("benchmark", 40), rows_of("documents", 120)
    rng = random.Random(5)
    planted = {}
    for k, (item, text) in enumerate(items):
        w = text.split()
        kind = k % 5
        if kind == 1:
            w = w[: -(len(w) // 12)] if len(w) > 24 else w
        elif kind == 2:
            w[-1] = "changed"
        elif kind == 3 and len(w) >= 52:
            w[len(w) // 2] = "changed"
        pad = [" ".join(rng.choice(docs)[1].split()[:60]) for _ in range(2)]
        planted[5000 + k] = (item, f"{pad[0]} {' '.join(w).upper()} {pad[1]}")
    rows = docs + [(i, t) for i, (_, t) in planted.items()] + [(7000, None), (7001, ""), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x y z")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench, how).collect()}
    assert got == brute_items(rows, items)
    assert sum((i, item) in got for i, (item, _) in planted.items()) >= 32
    again = decontam.contaminated(df, bench, decontam.Radar(slice_items=7)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in again} == got
    clean = decontam.without_benchmark(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    twice = spark.createDataFrame([(1, items[0][1], 3), (1, "other words", 3), (1, "other words", 3), (None, "more words", 3), (None, items[1][1], 3)], df.schema)
    assert sorted(r["text"] for r in decontam.without_benchmark(twice, bench).collect()) == ["more words", "other words", "other words"]
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_long_items_are_verified_within_seconds(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    item = words[1000:2000]
    near = [w if k % 97 else "other" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(words[:1000] + near + words[2000:])), (2, " ".join(words[:1300])), (3, "x " * 200_000), (4, " ".join(words * 2))], "doc_id long, text string")
    began = time.monotonic()
    got = decontam.contaminated(docs, spark.createDataFrame([(7, " ".join(item)), (8, "x " * 300)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (3, 8), (4, 7)} and time.monotonic() - began < 60
    assert {(r["doc_id"], r["similarity"], r["first_word"]) for r in got if r["doc_id"] > 2} == {(4, 1.0, 1000), (3, 1.0, 0)}


def test_pieces_of_items_at_either_end(spark):
    item = [f"word{k}" for k in range(200)]
    docs = [(1, " ".join(item[-60:])), (2, " ".join(item[:60])), (3, " ".join(["x"] * 5 + item[-60:] + ["y"] * 5)), (4, " ".join(item)), (5, " ".join(item[:190])), (6, " ".join(item[15:]))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {4, 5, 6} == {d for d, _ in brute_items(docs, [(9, " ".join(item))])}


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text, 1), (3, text, 1), (2, text, 2), (2, text + " x", 3), (None, text, 4), (7, None, 5), (7, None, 5), (8, "", 6), (None, "a b", 7), (None, "a b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, code int")
    kept = parity_join.one_of_each(df)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == df.columns and Counter(r[2] for r in got if r[2] > 3) == Counter({5: 2, 6: 1, 7: 1})
    assert len([r for r in got if r[2] <= 3]) == 1 and got[[r[2] <= 3 for r in got].index(True)][0] == 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_one_edit(spark):
    rng = random.Random(2)
    pairs = [("abc", "abc"), ("abc", "ab"), ("a", ""), ("😀b", "😁b"), ("😀", "b"), ("ab", "ba"), ("é" * 40, "é" * 39 + "e"), ("abcd", "bcde")]
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        pairs.append((a, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == (edits(r["a"], r["b"]) <= 1) for r in got)
    pairs += [("x" * k + "p" + "y" * j, "x" * k + q + "y" * j) for k in (0, 1, 30, 77) for j in (0, 2, 40) for q in ("", "q", "pq", "zz")]
    for r in line_dedup.unequal_middles(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect():
        assert edits(r["a"], r["b"]) == edits(r["x"], r["y"])
        if edits(r["a"], r["b"]) <= 1:
            assert max(len(r["x"]), len(r["y"])) <= max(len(r["a"]), len(r["b"])) / 8 + 3, r


def brute_dropped(rows, least):
    first = {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\v\f\r"):
                first.setdefault(line, ((d is not None, d or 0), p))
    by_length = defaultdict(list)
    for line in first:
        if len(line) >= least:
            by_length[len(line)].append(line)
    near = set()
    for line, at in first.items():
        if len(line) < least:
            continue
        for n in (len(line) - 1, len(line), len(line) + 1):
            for other in by_length.get(n, ()):
                if first[other] < at and sum(x != y for x, y in zip(line, other)) < 40 and edits(line, other) <= 1:
                    near.add(line)
                    break
    out = defaultdict(set)
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line in first and (line in near or first[line] != ((d is not None, d or 0), p)):
                out[d].add(p)
    return out


@pytest.mark.parametrize("how", [line_dedup.Lines(min_chars=8), line_dedup.Lines(min_chars=8, hot=3, fan=2, broadcast_bytes=0)])
def test_line_dedup_against_brute_force(spark, how):
    rng = random.Random(8)
    rows = []
    stock = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 30))) for _ in range(12)]
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(stock) if rng.random() < 0.7 else "".join(rng.choice("vwxyz") for _ in range(20)))
            if rng.random() < 0.5:
                k = rng.randrange(len(line))
                line[k : k + rng.randrange(2)] = [rng.choice("pq")] * rng.randrange(3)
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "short\nshort\n\n \n\nx\nshorn"), (105, "x"), (103, rows[0][1]), (None, stock[0]), (104, "item number 0001 of many\n" + "\n".join(f"item number {k:04d} of many" for k in range(40)))]
    rows += [rows[5]]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, h string, dropped int")
    got = line_dedup.line_report(df, how).collect()
    want = brute_dropped(rows, how.min_chars)
    assert len(got) == len(rows)
    for r in got:
        assert r["dropped"] == ",".join(map(str, sorted(want[r["doc_id"]]))), r
    out = line_dedup.without_repeats(df.withColumn("n_chars", F.char_length("text").cast("long")), how)
    assert out.columns == [*df.columns, "n_chars"] and all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())
    assert line_dedup.line_report(df.limit(0), how).count() == 0


def test_line_plan_is_native(spark, capsys):
    df = spark.createDataFrame([(1, "a" * 40), (2, "a" * 41)], "doc_id long, text string")
    line_dedup.line_report(df).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


PAGES = [(0, "http://a/\r\nx", "p" * 150), (1, "http://b/", "p" * 150), (2, None, "tiny"), (3, "u", "tiny"), (4, "u", None), (5, "é", "ü" * 70), (9, "u", "ü" * 70), (9, "u", "ü" * 70), (None, "u", "p" * 150), (7, "u", "long " * 100_000)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(df).collect())
    want = Counter()
    for i, _, t in PAGES:
        raw = (t or "").encode()
        first = min(j for j, _, u in PAGES if (u or "") == (t or "") and j is not None)
        again = len(raw) >= 100 and i is not None and i != first
        want[i, len(raw), warc.digest_of(raw), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    clash = df.selectExpr("*", "1 as digest", "2 as first", "3 as payload", "4 as bytes", "5 as record_type")
    warc.archive(clash, str(tmp_path), broadcast_bytes=0)
    assert Counter(tuple(r) for r in warc.read_pages(spark, str(tmp_path)).collect()) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ranges_filters_and_payloads(spark, tmp_path):
    rng = random.Random(4)
    pages = [(k, f"http://h{k % 3}/{k}", "".join(rng.choice("abc<>\n") for _ in range(rng.randrange(50, 3000)))) for k in range(300)]
    warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path))
    read = lambda **o: spark.read.format("warc").options(**o).load(str(tmp_path))
    rows = read(split_bytes="5000").collect()
    assert {(r["record_id"], bytes(r["payload"])) for r in rows} == {(f"<urn:page:{i}>", t.encode()) for i, _, t in pages} and len(rows) == 300
    assert read(payload="false").where("payload is null").count() == 300
    some = read().where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1/"))
    assert some.count() == 100
    reader = warc.WarcReader(str(tmp_path), True, 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("record_id",), ("<urn:page:3>",)), GreaterThan(("payload_length",), 3)]))
    assert len(rest) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    other = record.replace(b"warcinfo", b"resource").replace(b"urn:x", b"urn:y")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(other))
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("warcinfo", b"hello"), ("resource", b"hello")]
