"""Registered queries of the training-data operators, with the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgauge.llm import centroids, digests, html_text, line_dedup, mixing, packing, quality_rules, ranked_search, shards, simhash, token_counts, warc, weak_labels

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE_CHARS = 500
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str, oracle: str | None = None):
    """Register ``build(rows of the whole table)`` under a name."""

    def keep(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(spark.read.parquet(f"{folder}/{table}.parquet"))
        if oracle is not None:
            ORACLE[name] = oracle
        return build

    return keep


@query("op2_simhash_near_dedup", "documents")
def _(docs):
    groups = simhash.near_duplicates(docs)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op3_line_dedup", "documents")
def _(docs):
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


@query("op6_quality_rules", "documents")
def _(docs):
    table = quality_rules.quality_table(docs)
    return table.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op7_best_fit_packing", "documents")
def _(docs):
    return packing.packed(packing.token_pieces(docs, TOKENIZER))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS bucket,
    CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS name
  FROM documents),
sources AS (SELECT name, source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY name, source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w,
    row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM sources),
levels AS (
  SELECT *, ((SELECT sum(s) FROM sources) * 150 / 100e0 - 2 * coalesce(sum(s) OVER before, 0))
    / ((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY s / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT level FROM levels WHERE level * w <= 2 * s ORDER BY s / w, rank LIMIT 1),
targets AS (SELECT name, s, least(coalesce((SELECT level FROM settled) * w, 'inf'::DOUBLE), 2e0 * s) AS target FROM weighted),
placed AS (
  SELECT z.*, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0e0 END AS rate,
    row_number() OVER (PARTITION BY z.name ORDER BY size, bucket, doc_id) AS place,
    CAST('0x' || substr(md5('42|offset|' || z.name), 1, 8) AS BIGINT) / 4294967296e0 AS shift
  FROM sized z JOIN targets t ON z.name = t.name)
SELECT doc_id, size, s AS source_size, target,
  size * CAST(least(floor(place * rate + shift) - floor((place - 1) * rate + shift), 2) AS BIGINT) AS taken
FROM placed
"""


@query("op9_source_mix", "documents", MIX_SQL)
def _(docs):
    rows = mixing.with_copies(docs)
    return rows.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


@query("op5_document_fingerprints", "documents")
def _(docs):
    return digests.beside_next(docs).withColumnRenamed("id", "doc_id")


WARC_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
"""


@query("op8_warc_index", "pages", WARC_SQL)
def _(pages):
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_html_extraction", "pages")
def _(pages):
    return html_text.extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op1_token_counts", "documents")
def _(docs):
    counts = token_counts.section_tokens(docs, TOKENIZER, token_counts.passage_sections("text", PASSAGE_CHARS))
    return counts.select(F.col("id").alias("doc_id"), "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


@query("op4_quality_classifier", "documents")
def _(docs):
    return weak_labels.classified(docs).withColumnRenamed("id", "doc_id")


SHARD_SQL = """
WITH steps AS (  -- a byte moves the CRC by two steps of four bits
  SELECT i, CAST(i AS UBIGINT) AS t, 0 AS k FROM range(16) r(i)),
halves AS (
  WITH RECURSIVE moved AS (
    SELECT i, t, 0 AS k FROM steps
    UNION ALL SELECT i, xor(t >> 1, CASE WHEN t % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT), k + 1 FROM moved WHERE k < 4)
  SELECT list(t ORDER BY i) AS half FROM moved WHERE k = 4),
named AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS name,
    md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h
  FROM documents),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY h) AS r, count(*) OVER (PARTITION BY name) AS n,
    CAST('0x' || substr(md5('42|offset|' || name), 1, 8) AS BIGINT) / 4294967296e0 AS u
  FROM named),
placed AS (SELECT *, row_number() OVER (ORDER BY (r - u) / n, name, r) - 1 AS p, count(*) OVER () AS total FROM counted)
SELECT doc_id, CAST(octet_length(bytes) + 8 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: CAST('0x' || x AS UBIGINT)),
    lambda c, b: xor(xor(xor(c, b) >> 4, half[CAST(xor(c, b) % 16 AS BIGINT) + 1]) >> 4, half[CAST(xor(xor(c, b) >> 4, half[CAST(xor(c, b) % 16 AS BIGINT) + 1]) % 16 AS BIGINT) + 1]),
    CAST(4294967295 AS UBIGINT)), 4294967295::UBIGINT) AS BIGINT) AS text_crc32,
  'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard, CAST(p - ((p * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, halves
"""


@query("op13_sharding", "documents", SHARD_SQL)
def _(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.crc32(text).alias("text_crc32"), shards.shuffle_hash().alias("shuffled"))
    return shards.interleaved(rows, "source", "shuffled").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def centroid_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Plain rounds: every vector meets every centroid in each of them."""
    near = lambda r: f"""
d{r} AS (
  SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM parts v JOIN c{r} c ON v.dim = c.dim GROUP BY v.row, c.cluster),
a{r} AS MATERIALIZED (SELECT row, min(cluster) AS cluster, any_value(distance) AS distance FROM (SELECT *, min(distance) OVER (PARTITION BY row) AS least FROM d{r}) WHERE distance = least GROUP BY row)"""
    move = lambda r: f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.dim, CASE WHEN s.n IS NULL THEN c.x ELSE CAST((s.x - ((s.x % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS x
  FROM c{r} c LEFT JOIN (SELECT a.cluster, v.dim, sum(v.x) AS x, count(*) AS n FROM a{r} a JOIN parts v ON v.row = a.row GROUP BY a.cluster, v.dim) s
    ON s.cluster = c.cluster AND s.dim = c.dim)"""
    steps = ",".join(near(r) + "," + move(r) for r in range(rounds)) + "," + near(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
parts AS MATERIALIZED (SELECT row, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM kept),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM kept QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT f.cluster, p.dim, p.x FROM first f JOIN parts p ON p.row = f.row),{steps},
names AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, n.centroid_sha256
FROM kept k JOIN a{rounds} a ON a.row = k.row JOIN names n ON n.cluster = a.cluster
"""


@query("op11_centroid_clustering", "embeddings", centroid_sql())
def _(vectors):
    out = centroids.clustered(vectors)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


SEARCH_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
tfs AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY row),
facts AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
items AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM facts) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs GROUP BY term),
norms AS (SELECT row, 100 - 90 + (90 * n * (SELECT n_docs FROM facts)) // (SELECT n_terms FROM facts) AS m FROM sizes),
scores AS (
  SELECT a.item, a.item_id, t.row, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m))) AS BIGINT) AS score
  FROM asked a JOIN tfs t ON t.term = a.term JOIN weights w ON w.term = a.term JOIN norms m ON m.row = t.row GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def _search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked_search.ranked(docs, items).withColumnRenamed("id", "doc_id")


QUERIES["op12_ranked_search"] = _search
ORACLE["op12_ranked_search"] = SEARCH_SQL
