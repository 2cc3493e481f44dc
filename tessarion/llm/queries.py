"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessarion.llm import bradley_terry, decontam, line_dedup, mixing, ngram_lm, parity_join, pii, quality_rules, secret_scan, warc


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest,
  min(page_id) OVER (PARTITION BY sha256(t)) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM d
"""


OP7 = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM s WHERE parts IS NOT NULL),
b AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
every AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM b GROUP BY line),
f AS (SELECT * FROM every WHERE n >= 30),
c AS (
  SELECT x.line AS a, y.line AS b, x.first AS fa, y.first AS fb, x.n FROM f x JOIN f y ON x.n = y.n AND left(x.line, x.n // 2) = left(y.line, y.n // 2) AND x.line < y.line
  UNION SELECT x.line, y.line, x.first, y.first, x.n FROM f x JOIN f y ON x.n = y.n AND right(x.line, x.n - x.n // 2) = right(y.line, y.n - y.n // 2) AND x.line < y.line
  UNION SELECT x.line, y.line, x.first, y.first, x.n FROM f x JOIN f y ON x.n + 1 = y.n AND left(x.line, x.n // 2) = left(y.line, x.n // 2)
  UNION SELECT x.line, y.line, x.first, y.first, x.n FROM f x JOIN f y ON x.n + 1 = y.n AND right(x.line, x.n - x.n // 2) = right(y.line, x.n - x.n // 2)),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, n + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)), true) - 1, n) AS same FROM c),
near AS (SELECT DISTINCT CASE WHEN fa > fb THEN a ELSE b END AS line FROM p
  WHERE substr(a, same + CASE WHEN length(b) > n THEN 1 ELSE 2 END) = substr(b, same + 2)),
gone AS (SELECT b.doc_id, b.pos FROM b JOIN every USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR (b.doc_id, b.pos) <> every.first),
g AS (SELECT doc_id, count(DISTINCT pos) AS n, list_sort(list_distinct(list(pos))) AS ps FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(ps, ','), '') AS dropped
FROM s LEFT JOIN g USING (doc_id)
"""


# Links by definition: every pair of documents that shares a shingle, and what is reached from each by steps to the smallest neighbour.
OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
h AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(g) AS x FROM s)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.x WHERE r.root < u.b)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT x, min(root) AS component_id FROM r GROUP BY x) m ON m.x = n.doc_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_components(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op9(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scores, op2_secret_scan, op3_personal_data, op4_decontamination, op5_quality_scores, op6_warc, op7_line_dedup, op8_ngram_jaccard, op9_quality_rules, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6, "op7_line_dedup": OP7, "op8_ngram_jaccard": OP8}
