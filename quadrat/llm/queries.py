"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, langid, linededup, mixing, pieces, sharding, simhash, topk, toxicity, warc
from .common import table

PIECES = "piece_bpe_32k.model"
SHARD_BYTES = 1 << 20


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = linededup.dedup_lines(docs, removed_col="removed_lines")
    return clean.select("doc_id", F.size("removed_lines").alias("n_removed"), F.concat_ws(",", F.transform("removed_lines", lambda i: i.cast("string"))).alias("removed_lines"), F.sha2("text", 256).alias("clean_sha256"), "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.EVERY == 0)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ids=False).withColumnRenamed("id", "doc_id")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), limit=SHARD_BYTES).withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    every = planned.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return every.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_imatch, op2_simhash, op3_linededup, op4_toxicity, op5_warc, op6_topk, op7_pieces, op8_langid, op9_sharding, op10_mixing)}

_DIGESTS = len(imatch.SUBSETS)
_LIKENESS = f"""CASE WHEN {{a}} = {{b}} THEN 1.0 ELSE coalesce(len([i FOR i IN range(1, {_DIGESTS + 1}) IF {{a}}[i] = {{b}}[i] AND {{a}}[i] <> '{imatch.NONE}'])
  / nullif(len([i FOR i IN range(1, {_DIGESTS + 1}) IF {{a}}[i] <> '{imatch.NONE}' OR {{b}}[i] <> '{imatch.NONE}']), 0), 0.0) END"""

SQL = {
    "op1_imatch": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(body) OVER w, first_value(body) OVER w) AS after, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(body, 1, n - n // 2) || substring(after, 1, n // 2) AS edited FROM o),
x AS (SELECT doc_id, 0 AS kind, body AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, kind, unnest(list_distinct(string_split_regex(lower(t), '[\\x20\\x09-\\x0D]+'))) AS term FROM x),
f AS (SELECT term, count(*) AS df FROM w WHERE kind = 0 AND term <> '' GROUP BY term),
lex AS (SELECT term, sha256('i-match:' || term) AS h FROM f, (SELECT count(*) AS total FROM d) WHERE df BETWEEN greatest(2.0, {imatch.RARE} * total) AND greatest(2.0, {imatch.COMMON} * total)),
s AS (SELECT CAST(k - 1 AS INTEGER) AS k, [{", ".join(map(str, imatch.SUBSETS))}][k] AS share FROM range(1, {_DIGESTS + 1}) AS r(k)),
mk AS (SELECT term, h, k FROM lex, s WHERE k = 0 OR CAST('0x' || substr(h, 2 * k, 2) AS INTEGER) < share),
m AS (SELECT mk.term, k, number FROM mk JOIN (SELECT term, ((CAST('0x' || substr(any_value(h), 49, 10) AS BIGINT) >> 1) << {_DIGESTS}) + CAST(sum(1 << k) AS BIGINT) AS number FROM mk GROUP BY term) USING (term)),
g AS (SELECT doc_id, kind, k, substr(md5(string_agg(CAST(number AS VARCHAR), ' ' ORDER BY number)), 1, {imatch.DIGEST}) AS h FROM w JOIN m USING (term) GROUP BY 1, 2, 3),
a AS (SELECT x.doc_id, x.kind, any_value(x.t) AS t, list(coalesce(g.h, '{imatch.NONE}') ORDER BY s.k) AS l FROM x CROSS JOIN s LEFT JOIN g ON g.doc_id = x.doc_id AND g.kind = x.kind AND g.k = s.k GROUP BY 1, 2),
p AS (SELECT doc_id, kind, CASE WHEN len(list_filter(l, lambda y: y <> '{imatch.NONE}')) = 0 THEN [substr(md5(t), 1, {imatch.DIGEST}) FOR i IN range(0, {_DIGESTS})] ELSE l END AS l FROM a)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(p.l, '') AS fingerprint, array_to_string(q.l, '') AS edited_fingerprint,
  {_LIKENESS.format(a="p.l", b="q.l")} AS near_edited, {_LIKENESS.format(a="p.l", b="z.l")} AS near_next
FROM e JOIN p ON p.doc_id = e.doc_id AND p.kind = 0 JOIN p q ON q.doc_id = e.doc_id AND q.kind = 1 JOIN p z ON z.doc_id = e.next_id AND z.kind = 0
""",
    "op5_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT s, max(page_id) AS top FROM p WHERE n >= {warc.LEAST} GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN top IS NULL OR top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (s)
""",
    "op6_topk": f"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {topk.EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {topk.TOP}
""",
    "op3_linededup": r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c FROM lines, range(1, len(l) - 1) AS r(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w WHERE regexp_matches(a || b || c, '[^\x20\x09\x0B-\x0D]')),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, range(0, 3) AS r(k) WHERE n > 1),
held AS (SELECT doc_id, list(pos ORDER BY pos) AS gone FROM gone GROUP BY doc_id),
j AS (SELECT d.doc_id, d.l, d.text, h.gone FROM lines d LEFT JOIN held h USING (doc_id)),
k AS (SELECT doc_id, coalesce(gone, []) AS gone,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i - 1)], chr(10)), '') END AS text FROM j)
SELECT doc_id, CAST(len(gone) AS INTEGER) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines, sha256(text) AS clean_sha256, text FROM k
""",
    "op9_sharding": f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 10) AS BIGINT) AS h FROM documents),
p AS (SELECT doc_id, n_bytes, CAST(k AS INTEGER) AS depth, h >> (40 - k) AS prefix FROM d, range(0, 41) AS r(k)),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n FROM p GROUP BY depth, prefix),
best AS (SELECT p.doc_id, p.n_bytes, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {SHARD_BYTES} OR s.n = 1 GROUP BY p.doc_id, p.n_bytes)
SELECT b.doc_id, b.n_bytes, CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(p.prefix), b.depth, '0') END AS shard, b.depth, s.shard_bytes
FROM best b JOIN p ON p.doc_id = b.doc_id AND p.depth = b.depth JOIN s ON s.depth = p.depth AND s.prefix = p.prefix
""",
    "op10_mixing": f"""
WITH sized AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size FROM documents),
e AS (SELECT doc_id, source, size, count(*) AS n, CAST(size * count(*) AS BIGINT) AS words, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name FROM sized GROUP BY doc_id, source, size),
t AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM e GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 2 * source_size AS most, (sum(source_size) OVER ()) * 3 / 2 AS budget FROM t),
r AS (SELECT *, most / weight AS ratio FROM w),
l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
m AS (SELECT *, row_number() OVER (ORDER BY ratio, place) AS nth FROM l),
x AS (SELECT min_by(level, nth) AS final, min(nth) AS first_open FROM m WHERE level <= ratio),
g AS (SELECT m.source, m.source_size, m.place, m.budget, CASE WHEN m.nth >= x.first_open THEN m.weight * x.final ELSE CAST(m.most AS DOUBLE) END AS target FROM m, x),
q AS (SELECT e.*, g.source_size, g.place, g.budget, g.target, CAST('0x' || substr(md5('{mixing.SEED}:' || name), 1, 10) AS BIGINT) AS key FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source),
u AS (SELECT *, CAST(sum(words) OVER (PARTITION BY place ORDER BY key, name, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM q),
p AS (SELECT *, (k * source_size + run) / target AS finish, k AS pass FROM u, range(0, 2) AS r(k) WHERE target > 0),
o AS (SELECT *, sum(words) OVER (ORDER BY finish, place, key, name, size, pass ROWS UNBOUNDED PRECEDING) AS spent FROM p),
c AS (SELECT doc_id, source, size, CAST(sum(CASE WHEN spent <= budget THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM o GROUP BY doc_id, source, size)
SELECT u.doc_id, CAST(u.size AS BIGINT) AS size, u.source_size, u.target, CAST(coalesce(c.copies, 0) * u.size AS BIGINT) AS taken
FROM u LEFT JOIN c ON u.doc_id IS NOT DISTINCT FROM c.doc_id AND u.source IS NOT DISTINCT FROM c.source AND u.size = c.size, range(0, u.n)
""",
}
