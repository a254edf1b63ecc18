"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import alignment, ann, bpe, clustering, fingerprint, language_model, mixing, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from corvane.llm.common import document_crc

#: Vocabularies, parameters of the operators, never copied here: of op9, op12, and op13 with the first.
VOCABULARY, WORD_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.place(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    held_out = document_crc() % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "cosines")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "links", "copies", "n_shingles")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), digests=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = document_crc() % 4 == 2
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("computed")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(WORD_VOCABULARY))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), vocabulary_path(PIECE_MODEL))


OP1_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS v FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, length(h) // 2 + 1 AS size, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || array_slice(h, 2 * i + 1, 2 * i + 2) AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size,
        xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, y: xor(c >> 8, t.v[xor(c & 255, y) + 1])), 4294967295) AS text_crc32 FROM x, t),
u AS (SELECT *, list_transform(range(0, 9), lambda i: -1.0::DOUBLE / ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)) AS sc,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS h FROM c),
p AS (SELECT *, CAST(list_position(sc[1:8], list_max(sc[1:8])) - 1 AS INT) AS shard, CAST(list_position(sc, list_max(sc)) - 1 AS INT) AS grown_shard FROM u)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(h, 1, 4) AS INT) % 1024, h, doc_id, size) - 1 AS BIGINT) AS slot, grown_shard
FROM p
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))))
    WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END AS s FROM w),
d AS MATERIALIZED (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN hash(s) END AS node, s FROM s),
nodes AS MATERIALIZED (SELECT node, any_value(n) AS n, count(*) AS copies, min(doc_id) AS least, any_value(s) AS s FROM d WHERE node IS NOT NULL GROUP BY node),
g AS MATERIALIZED (SELECT node, n, unnest(s) AS gram FROM nodes),
pairs AS MATERIALIZED (
  SELECT a.node AS x, b.node AS y FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
cls AS (SELECT node, least(least, coalesce((SELECT min(m.least) FROM reach r JOIN nodes m ON m.node = r.y WHERE r.x = nodes.node), least)) AS class_id FROM nodes),
links AS (SELECT p.x AS node, CAST(sum(m.copies) AS BIGINT) AS links FROM pairs p JOIN nodes m ON m.node = p.y GROUP BY p.x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(l.links, 0) + coalesce(m.copies, 1) - 1 AS BIGINT) AS links,
       CAST(coalesce(m.copies, 1) AS BIGINT) AS copies, CAST(d.n AS BIGINT) AS n_shingles
FROM d LEFT JOIN nodes m ON m.node = d.node LEFT JOIN cls c ON c.node = d.node LEFT JOIN links l ON l.node = d.node
"""
OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS MATERIALIZED (SELECT doc_id, p, hash(array_slice(b, p, p + 199)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS p FROM n WHERE n >= 200)),
r AS (SELECT doc_id, p FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM r)),
c AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS since FROM c),
j AS (SELECT k.doc_id, string_agg(hex(array_slice(b, since, lo - 1)), '' ORDER BY lo) AS head, max(hi) AS tail, sum(hi - lo) AS gone, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(array_slice(b, CAST(coalesce(tail, 1) AS BIGINT), n)))) AS kept_sha256
FROM n LEFT JOIN j USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, CASE WHEN size < 64 THEN size ELSE length(bin(size)) * 64 + (size >> CAST(length(bin(size)) - 6 AS INT)) END AS cls FROM d),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY cls, CAST('0x' || substr(h, 1, 3) AS INT) % 4096, h, doc_id, size) - 1 AS DOUBLE) AS rk,
         CAST(sum(size) OVER (PARTITION BY k) AS BIGINT) AS source_size
  FROM c),
t0 AS (
  SELECT k, source_size, CAST(CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM (SELECT DISTINCT k, source_size FROM r)),
t1 AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM t0),
t2 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM t1),
t3 AS (
  SELECT *, (SELECT (x.budget - x.capped) / x.open FROM t2 x WHERE (x.budget - x.capped) / x.open * x.w <= x.cap ORDER BY x.cap / x.w, x.k LIMIT 1) AS level FROM t2),
t AS (
  SELECT k, coalesce(least(cap, level * w), cap) AS target,
         CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, coalesce(least(cap, level * w), cap) / source_size) ELSE 0 END AS rate,
         (CAST(CAST('0x' || substr(md5('11:' || k), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM t3),
e AS (
  SELECT r.doc_id, r.size, r.source_size, t.target, r.source,
         CAST(least(floor((rk + 1) * rate + u) - floor(rk * rate + u), 2) AS BIGINT) AS copies
  FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM e
"""

def _op11_sql(rounds: int = 3) -> str:
    """Lloyd's rounds, each a step: distances to all centroids, the nearest, and floors of the means."""
    dist = "CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i]))) AS BIGINT)"
    steps = ["""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INT) AS k, v AS c FROM x
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) <= 16)"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.rid, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min({{'d': {dist}, 'k': c.k}}) AS m FROM x CROSS JOIN c{r} c GROUP BY x.rid)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, list(q ORDER BY i) AS c FROM (
    SELECT m.k AS k, i, CAST(sum(v[i]) // count(*) - CASE WHEN sum(v[i]) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS q FROM a{r}, range(1, 65) t(i) GROUP BY m.k, i) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} ON s{r}.k = c{r}.k)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.m.k AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k
"""


QUERIES = {"op1_sharding": op1_sharding, "op2_toxicity": op2_toxicity, "op3_fingerprints": op3_fingerprints, "op4_ngram_join": op4_ngram_join, "op5_suffix_dedup": op5_suffix_dedup, "op6_language_model": op6_language_model, "op7_ann": op7_ann, "op8_mixing": op8_mixing, "op9_bpe": op9_bpe, "op10_quality": op10_quality, "op11_clustering": op11_clustering, "op12_packing": op12_packing, "op13_alignment": op13_alignment}
ORACLE_SQL = {"op1_sharding": OP1_SQL, "op4_ngram_join": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op11_clustering": _op11_sql()}
