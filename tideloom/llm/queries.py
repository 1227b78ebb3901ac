"""Queries over the driver's tables for the operators of this subpackage, and
the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode, n_tokens
from .collocations import collocations
from .decontaminate import leaks
from .embedding import near_vectors
from .fim import fill_in_middle, restored
from .labelled import HELD_OUT, fold
from .minhash import near_duplicates
from .mixing import mix
from .pii import PATTERNS, joined, personal_data
from .quality import fit_quality
from .shared import shared_dir
from .sharding import shards
from .substring import repeated_passages
from .toxicity import fit_toxicity
from .warc import parsed, read_archive, records, write_archive

#: Bytes of text a shard may hold.
SHARD_BYTES = 8 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    kept = F.coalesce("kept", F.lit(False)).alias("kept")
    return docs.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    each = mixed.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    copies = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("n") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select(F.col("id").alias("doc_id"), "bytes", F.col("depth").cast("int").alias("depth"), "prefix", "page", "shard_bytes")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", F.col("start").alias("match_start"), F.col("end").alias("match_end"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(_table(spark, sf_dir, "documents"), length=200)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, m -> m.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in PATTERNS]
    both = F.concat_ws(",", F.expr(f"nullif({joined('base')}, '')"), F.expr(f"nullif({joined('found')}, '')"))
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), both.alias("spans"), F.size("found").cast("bigint").alias("n_found"), (F.size("base") + F.size("found")).cast("bigint").alias("n_spans"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(_table(spark, sf_dir, "pages"), path)
    back = parsed(records(read_archive(spark, path)))
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def _judged(scores: DataFrame, least: float) -> DataFrame:
    held_out = (fold(F.col("id")) == HELD_OUT).alias("held_out")
    return scores.select(F.col("id").alias("doc_id"), held_out, "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(fit_toxicity(docs, _table(spark, sf_dir, "labels")).score(docs), 0.3)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(fit_quality(docs, _table(spark, sf_dir, "labels")).score(docs), 0.7)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def vocabulary() -> str:
    """The vocabulary file of the encoding query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    codes = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    return codes.select(F.col("id").alias("doc_id"), n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS n, b AS m FROM l UNION SELECT reach.n, l.b FROM reach JOIN l ON reach.m = l.a
), least AS (
  SELECT n, min(m) AS m FROM reach GROUP BY n
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN least ON s.doc_id = least.n
"""

OP3_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), b AS (
  SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix, doc_id, bytes, h,
         sum(bytes) OVER () AS total, min(h) OVER () AS lo, max(h) OVER () AS hi
  FROM r
  UNION ALL
  SELECT depth + 1, h >> (59 - depth), doc_id, bytes, h,
         sum(bytes) OVER (PARTITION BY h >> (59 - depth)), min(h) OVER (PARTITION BY h >> (59 - depth)), max(h) OVER (PARTITION BY h >> (59 - depth))
  FROM b WHERE total > {SHARD_BYTES} AND lo < hi
), leaf AS (
  SELECT *, max(bytes) OVER (PARTITION BY depth, prefix) AS most,
         row_number() OVER (PARTITION BY depth, prefix ORDER BY bytes) - 1 AS n
  FROM b WHERE total <= {SHARD_BYTES} OR lo = hi
), paged AS (
  SELECT doc_id, bytes, depth, prefix, total, CASE WHEN total <= {SHARD_BYTES} THEN 0
    ELSE CAST(floor(n / greatest(1, floor({SHARD_BYTES} / greatest(most, 1)))) AS BIGINT) END AS page
  FROM leaf
)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CAST(depth AS INTEGER) AS depth, CAST(prefix AS BIGINT) AS prefix, CAST(page AS BIGINT) AS page,
       CAST(sum(bytes) OVER (PARTITION BY depth, prefix, page) AS BIGINT) AS shard_bytes
FROM paged
"""

#: Bytes as pairs of hex digits, since strings are cut by characters; windows are
#: taken from pieces that hold 400 of them. Starts of repeated windows that are 200 bytes apart or less belong to one removed run.
OP5_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS (
  SELECT r, o, h[2 * o + 1:2 * o + 1198] AS t FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 400)) AS o FROM d WHERE len(h) >= 400)
), w AS (
  SELECT r, o + j AS i, md5(t[2 * j + 1:2 * j + 400]) AS k FROM (SELECT r, o, t, unnest(range(0, len(t) // 2 - 199)) AS j FROM piece)
), twice AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w JOIN twice USING (k)
), cut AS (
  SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit
), span AS (
  SELECT r, g, min(i) AS lo, max(i) + 200 AS hi FROM cut GROUP BY r, g
), kept AS (
  SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS since FROM span
), told AS (
  SELECT d.r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(h[2 * since + 1:2 * lo], '' ORDER BY lo) || any_value(h)[2 * max(hi) + 1:] AS rest FROM kept JOIN d USING (r) GROUP BY d.r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN told USING (r)
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), f AS (
  SELECT page_id, n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a AS n, b AS m FROM l
  UNION
  SELECT reach.n, l.b FROM reach JOIN l ON reach.m = l.a
), least AS (
  SELECT n, min(m) AS m FROM reach GROUP BY n
), degree AS (
  SELECT a, count(*) AS k FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(k, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN least ON v.vec_id = least.n LEFT JOIN degree ON v.vec_id = degree.a
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents
), w AS (
  SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), cut AS (
  SELECT lang, c.k, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM c, range(1, 4) t(j) WHERE j < c.k
), scored AS (
  SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN held USING (lang, phrase) WHERE o = 1 AND NOT coalesce(100 * most >= 80 * a, FALSE)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents
), x AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) for i in range(0, 4)] AS h FROM d
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
), p AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_source_mixing": op2_source_mixing,
        "op3_extendible_sharding": op3_extendible_sharding,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_repeated_passages": op5_repeated_passages,
        "op6_personal_data": op6_personal_data,
        "op7_warc_archive": op7_warc_archive,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_bpe_round_trip": op12_bpe_round_trip,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op3_extendible_sharding": OP3_SQL, "op5_repeated_passages": OP5_SQL, "op7_warc_archive": OP7_SQL, "op10_embedding_near_dedup": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
