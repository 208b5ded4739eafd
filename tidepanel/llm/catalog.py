"""Registered queries of this subpackage and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidepanel.llm import bpe, centroids, collocations, decontaminate, hpylm, html_text, langid, linededup, pii, quality, simhash, topk, warc
from tidepanel.llm.common import table
from tidepanel.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


WORDS_SQL = """list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS_SQL} AS w FROM benchmark),
s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS run FROM s),
l AS (SELECT DISTINCT n FROM v),
p AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, l),
r AS (SELECT id, k, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM p),
h AS (SELECT r.id, r.k, r.n, v.item FROM r JOIN v ON r.run = v.run AND r.n = v.n),
c AS (SELECT id, count(DISTINCT x) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS x FROM h) GROUP BY id),
m AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.id = c.id LEFT JOIN m ON d.id = m.id
"""


@query("op1_decontaminate", DECONTAMINATE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op3_topk", TOPK_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


@query("op9_warc", WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "lang", "n_words", "perplexity", "threshold", "kept")


@query("op8_hpylm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


LINES_SQL = f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS id, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS line FROM d WHERE text IS NOT NULL),
w AS (SELECT id, line, trim(regexp_replace(x, '[ \\t-\\r]+', ' ', 'g')) AS x FROM e),
n AS (SELECT id, line, x, len(string_split(x, ' ')) AS words, row_number() OVER (ORDER BY id, line) + id AS place FROM w WHERE x <> ''),
s AS (SELECT n.*, sum(words) OVER (PARTITION BY id ORDER BY place) AS summed FROM n),
pairs AS (
    SELECT a.place AS i, b.place AS j, 1 AS m FROM s a JOIN s b ON a.x = b.x AND b.place < a.place
    UNION ALL
    SELECT p.i, p.j, p.m + 1 FROM pairs p JOIN s a ON a.place = p.i + p.m JOIN s b ON b.place = p.j + p.m AND a.x = b.x),
longest AS (SELECT i, max(m) AS m FROM pairs GROUP BY i),
runs AS (
    SELECT i, i + m AS upto FROM longest JOIN s a ON a.place = i JOIN s z ON z.place = i + m - 1
    WHERE z.summed - a.summed + a.words >= {linededup.MIN_WORDS}),
cover AS (SELECT s.id, s.line, s.place, max(upto) OVER (PARTITION BY s.id ORDER BY s.place) AS reach FROM s LEFT JOIN runs ON runs.i = s.place),
gone AS (SELECT id, line, place, lead(place) OVER (PARTITION BY id ORDER BY place) AS later, lead(line) OVER (PARTITION BY id ORDER BY place) AS following FROM cover WHERE reach > place),
cut AS (SELECT DISTINCT id, unnest(range(line, CASE WHEN later = place + 1 THEN following ELSE line + 1 END)) AS line FROM gone),
kept AS (
    SELECT e.id, string_agg(e.x, chr(10) ORDER BY e.line) AS text, count(*) AS n FROM e LEFT JOIN cut ON e.id = cut.id AND e.line = cut.line
    WHERE cut.line IS NULL GROUP BY e.id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(len(l), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(l), 0) - coalesce(n, 0) AS INTEGER) AS n_deleted
FROM d LEFT JOIN kept ON d.id = kept.id
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


@query("op11_langid")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = f"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d),
w AS (SELECT lang, list_filter(string_split_regex(x, '[ \\t]+'), lambda v: v <> '') AS w FROM p),
s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS m)),
f AS (SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {collocations.LEAST}),
x AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM c),
y AS (
    SELECT x.lang, x.phrase, x.a, n.n, x.k, fl.a AS l, fr.a AS r,
           CAST((1000 * CAST(x.a AS HUGEINT) * n.n) // (CAST(fl.a AS HUGEINT) * fr.a) AS BIGINT) AS score
    FROM x JOIN n ON n.lang = x.lang
    JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(w[1:k], ' ')
    JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(w[k + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (
    SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, a
    FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c))),
q AS (SELECT z.* FROM z WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = z.lang AND g.phrase = z.phrase AND g.a >= z.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM q QUALIFY rank <= {collocations.TOP}
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _centroids_sql() -> str:
    rounds = []
    for t in range(centroids.ROUNDS + 1):
        rounds.append(f"""
a{t} AS (
    SELECT id, vec_id, v, number AS cluster, d AS distance
    FROM (SELECT p.*, c.number, CAST(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d FROM p, c{t} c)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, number) = 1)""")
        if t < centroids.ROUNDS:
            rounds.append(f"""
m{t} AS (
    SELECT cluster, list(f ORDER BY i) AS v
    FROM (SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f
          FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY ALL))
    GROUP BY cluster),
c{t + 1} AS (SELECT number, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} ON m{t}.cluster = number)""")
    return f"""
WITH p AS (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS number, v
    FROM (SELECT *, sha256('{centroids.SEED}:' || vec_id) AS h FROM p WHERE vec_id IS NOT NULL) QUALIFY row_number() OVER (ORDER BY h, v) <= {centroids.CLUSTERS}),
{",".join(rounds)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN c{centroids.ROUNDS} c ON c.number = a.cluster
"""


@query("op13_centroids", _centroids_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
