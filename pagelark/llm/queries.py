"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, minhash_forest, mixing, ngram_join, packing, pii, prefix_trie, quality_mil, secret_scan, sharding, spelling, topk_hamming
from .common import crc_bucket, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = quality_mil.score(docs, model)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"), ngram=4, percent=85)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.concat("base", "added")).alias("spans"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{secret_scan.KINDS[rank]}")
    return found.select(
        "doc_id",
        *[count(rank) for rank in range(3)],
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.concat("base", "added")).alias("spans"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), capacity=1024)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_hamming.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.regrafted_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("first", "last")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.words_of(docs, damage=31), ratio=10)


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.components(table(spark, sf_dir, "documents").select("doc_id", "text"), ngram=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_language_id": op2_language_id,
        "op3_quality_mil": op3_quality_mil,
        "op4_ngram_join": op4_ngram_join,
        "op5_pii": op5_pii,
        "op6_sharding": op6_sharding,
        "op7_mixing": op7_mixing,
        "op8_secret_scan": op8_secret_scan,
        "op9_packing": op9_packing,
        "op10_topk_hamming": op10_topk_hamming,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_spelling": op12_spelling,
        "op13_minhash_forest": op13_minhash_forest,
    }


OP1_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM normal
"""


OP10_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, v.embedding),
                                      lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS hamming
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hamming, neighbor_id) AS INTEGER) AS rank,
         neighbor_id, hamming
  FROM pairs
)
SELECT query_id, rank, neighbor_id, hamming FROM ranked WHERE rank <= 10
"""


#: crc32 of an expression's text in SQL, bit by bit: each byte is xored in (its number) and followed by eight shifts (-1).
CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

OP11_SQL = f"""
WITH filled AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT c, code, strlen(text) AS bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 64), code) AS p FROM filled
), lengths AS (
  SELECT c, count(*) AS n FROM turns GROUP BY c
), heads AS (
  SELECT c, n, c - c % 5 AS base, CAST({CRC32.format("CAST(c AS VARCHAR)")} AS BIGINT) % 9 AS h FROM lengths
), convs AS (
  SELECT a.c, a.n, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM heads a LEFT JOIN lengths b ON b.c = a.base
), rebuilt AS (
  SELECT v.c, v.taken + t.p - v.h AS d, code, bytes FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h
  UNION ALL
  SELECT v.c, t.p AS d, code, bytes FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
), paths AS (
  SELECT c, d, bytes, string_agg(code, '/') OVER (PARTITION BY c ORDER BY d) AS prefix,
         d = max(d) OVER (PARTITION BY c) AS ends
  FROM rebuilt
  UNION ALL
  SELECT c, 0 AS d, 0 AS bytes, '' AS prefix, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.c = v.c) AS ends FROM convs v
), nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE left(prefix, 33 * (d - 1) - 1) END AS up,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY d, prefix
), children AS (
  SELECT up AS prefix, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), counted AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k USING (prefix)
), subtrees AS (
  SELECT p.prefix, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM counted b JOIN paths p ON p.c = b.conv_id AND p.d <= b.d GROUP BY p.prefix
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s USING (prefix) LEFT JOIN nodes u ON u.prefix = n.up
"""


OP12_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents
), low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, c, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS b
  FROM low
), hashed AS (
  SELECT run, c, CAST(xor(list_reduce(list_concat([4294967295], flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS BIGINT) AS h
  FROM bytes
), damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gone AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT g.word, w.word, w.n FROM gone g JOIN words w ON w.word = g.rest
  UNION
  SELECT w.word, g.word, g.n FROM gone g JOIN words w ON w.word = g.rest
), ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS r FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN b END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op10_topk_hamming": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_spelling": OP12_SQL}
