"""The registered queries of the subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, counts, decontaminate, divergence, language, licenses, neardup, repeats, secrets, topk, toxicity, urls
from .shared import read

VOCABULARY, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(read(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(read(spark, sf_dir, "documents"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(read(spark, sf_dir, "embeddings"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.digest(read(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(read(spark, sf_dir, "embeddings"))


def op13_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts.digest(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {"op11_divergence": op11_divergence, "op12_clusters": op12_clusters, "op13_counts": op13_counts, "op6_repeats": op6_repeats, "op7_topk": op7_topk, "op1_licenses": op1_licenses, "op4_language": op4_language, "op8_urls": op8_urls, "op10_secrets": op10_secrets, "op5_toxicity": op5_toxicity, "op2_decontaminate": op2_decontaminate, "op3_neardup": op3_neardup, "op9_bpe": op9_bpe}

def _clusters_sql() -> str:
    """Five rounds of assignment and moves, written out, and the last assignment."""
    nearest = lambda at: f"SELECT v.row, v.vec_id, v.x, min_by({{'c': c.c, 'd': d.d}}, (d.d, c.c)) AS best FROM v, {at} c, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d) d GROUP BY v.row, v.vec_id, v.x"
    mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 40) f)",
    ]
    for r in range(5):
        parts.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        sums = f"SELECT best.c AS c, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT c, list({mean} ORDER BY i) AS x FROM ({sums}) s GROUP BY c) m ON c{r}.c = m.c)")
    parts.append(f"a AS MATERIALIZED (SELECT vec_id, best.c AS c, best.d AS distance FROM ({nearest('c5')}) z)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a JOIN c5 ON a.c = c5.c"""


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 10
""",
    "op2_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g FROM i),
size AS (SELECT DISTINCT n FROM win),
pos AS (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, size WHERE len(w) >= n),
hit AS (SELECT row_id, p, win.n, item_id FROM (SELECT row_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM pos) q JOIN win ON q.n = win.n AND q.g = win.g),
covered AS (SELECT row_id, count(DISTINCT x) AS n_hit FROM (SELECT row_id, unnest(range(p, p + n)) AS x FROM hit) y GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS s FROM hit) z GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT lang, source, row, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS BIGINT) AS p,
  CAST(1 + (CAST(1000000000 AS HUGEINT) * (whole + 1)) // (sum(whole) OVER s + count(*) OVER s) AS BIGINT) AS q FROM kc WINDOW s AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(v, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.o = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM
  (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term) u) r WHERE part = 'pair' OR rank <= 200
""",
    "op12_clusters": _clusters_sql(),
}
