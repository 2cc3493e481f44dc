import shutil
from collections import Counter

import corpus_pipeline
import pytest
import zstandard
from tests.llm.test_pairs_warc import brute_components, brute_dropped, brute_items

from tessarion.llm import decontam, parity_join
from tessarion.llm.quality_rules import Bands, measure

SMALL = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == names
            after = Counter((r["doc_id"], r["text"]) for r in docs.collect())
            assert after == brute_stage(spark, name, before), name
        if name == "ngram_jaccard":
            assert parity_join.near_components(docs).where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontam.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert counts[0] > counts[1] >= counts[2] >= counts[3] >= counts[4] == counts[5] > 100
    assert corpus_pipeline.run(spark, SMALL).count() == counts[5]
    shutil.rmtree(tmp_path)


def brute_stage(spark, name, rows):
    """What a stage leaves of rows (id, text) whose ids differ, by definition."""
    if name == "quality_rules":
        press = zstandard.ZstdCompressor(level=3)
        return Counter(r for r in rows if measure(r[1], Bands(), press)[-1])
    if name == "line_dedup":
        gone, out = brute_dropped(rows, 30), Counter()
        for d, t in rows:
            left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
            if d not in gone or left.split():
                out[d, left] += 1
        return out
    if name == "ngram_jaccard":
        keep = {c for _, _, c in brute_components(rows)}
        return Counter(r for r in rows if r[0] in keep)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_items(rows, items)}
    return Counter(r for r in rows if r[0] not in bad)


CLASH = ["rules", "id", "code", "dropped", "kept", "copies", "node", "bucket", "__id", "__text", "size", "start", "target", "si", "key", "label", "n", "a", "b", "h", "pos", "line"]


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_rows_and_clashing_columns(spark, rows_of, name):
    prose = [t for _, t in rows_of("documents", 60) if len(t.split()) > 80][:6]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(None, None), (None, ""), (1, None), (1, ""), (2, " \n\t"), (None, prose[0]), (None, prose[0]), (3, prose[0]), (3, prose[0]), (4, prose[1]), (4, prose[2]), (5, " ".join(prose) * 20)]
    rows += [(None, f"{prose[3]}\n{item}"), (6, f"{prose[3]} {item}"), (7, "x" * 300_000), (8, "word " * 60_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)
    full = [(i, t, None, [None, "a", "b"][k % 3], None if t is None else len(t), *range(len(CLASH))) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, schema)
    got = STAGE[name](spark, docs, SMALL)
    found = got.collect()
    if name == "mixing":
        assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
        assert STAGE[name](spark, docs.limit(0), SMALL).count() == 0
        return
    assert got.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in found)
    texts = Counter((r["doc_id"], r["text"]) for r in found)
    if name == "quality_rules":
        press = zstandard.ZstdCompressor(level=3)
        assert texts == Counter(r for r in rows if measure(r[1], Bands(), press)[-1])
    elif name == "line_dedup":
        assert texts[1, None] == 1 and texts[None, None] == 1 and texts[None, prose[0]] == 2 and not any(i == 3 for i, _ in texts)
    elif name == "ngram_jaccard":
        assert texts[3, prose[0]] == 1 and texts[None, prose[0]] == 0 and texts[4, prose[1]] == 1 and texts[4, prose[2]] == 1
        assert all(texts[r] == 1 for r in rows[:5])
    else:
        assert texts == Counter(r for r in rows if item not in (r[1] or ""))
    assert STAGE[name](spark, docs.limit(0), SMALL).count() == 0
