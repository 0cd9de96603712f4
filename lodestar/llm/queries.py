"""The queries of this folder's operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, fim, hardneg, hnsw, licenses, mixing, naming, ngramjoin, packing, quality, suffixes, topk, urls

URL_RULES = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The rank file of the contract's vocabulary: the same ids as its JSON, four times as fast (tests compare both)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=1024)


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, train=~held_out(F.col("k")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup_chunks(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, k=10)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(table(spark, sf_dir, "documents")).drop("n_points")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"), scale=256, keep=("label",))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(x, 256).alias(f"{x}_sha256") for x in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can say: exact places of the phrases."""
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def urls_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can say: hosts, paths and what the rules decide."""
    judged = op10_urls(spark, sf_dir)
    return judged.select(
        "page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"),
    )


QUERIES = {
    f.__name__: f for f in (
        op1_packing, op2_hnsw, op3_mixing, op4_jaccard, op5_quality, op6_chunks, op7_licenses, op8_topk, op9_suffixes,
        op10_urls, op11_naming, op12_negatives, op13_fim, licenses_base, urls_rules,
    )
}

def _places(phrase: str) -> str:
    words = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
    return f"list_filter(range(len(ws)), lambda i: {words})"


def _rules_sql() -> str:
    """CASE branches of the rules, longest first."""
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    longest = sorted(URL_RULES, key=lambda x: -len(x[1]))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(v, r)}'" for v, r in longest) + " END"
    return f"{case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS ruled"


ORACLE = {
    "licenses_base": f"""
WITH w AS (SELECT doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []::VARCHAR[]) AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, {", ".join(f"{_places(p)} AS l{k}" for k, p in enumerate(licenses.PHRASES))} FROM w),
a AS (SELECT *, {" || ".join(f"l{k}" for k in range(len(licenses.PHRASES)))} AS found FROM p)
SELECT doc_id, n AS n_words, len(found) AS n_base, list_min(found) AS first_word, list_max(found) AS last_word,
  array_to_string(list_sort(list_distinct({" || ".join(f"CASE WHEN len(l{k}) > 0 THEN ['{v}'] ELSE []::VARCHAR[] END" for k, v in enumerate(licenses.PHRASES.values()))})), ',') AS base_labels FROM a
""",
    "urls_rules": f"""
WITH x AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {_rules_sql()} FROM x
""",
    "op2_hnsw": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(c) AS component_id, min(c) = r.vec_id AS kept FROM r
  LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
""",
    "op3_mixing": """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
f AS (
  SELECT *,
    w * (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE > 3 * source_size * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS capped
  FROM src WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
    ELSE w * (sum(source_size) OVER () - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())::DOUBLE
    / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE w END) OVER () END AS target FROM f),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT
    ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size,
  round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM r
""",
    "op4_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' '
      || ws[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
    GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, b.b FROM r JOIN both_ways b ON r.c = b.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id
  GROUP BY n.doc_id, n.n
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a
    JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_suffixes": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n
  FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM h)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM w),
m AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS jump
  FROM f WHERE r > 1),
i AS (SELECT doc_id, s, sum(jump) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, island),
k AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM p
  UNION ALL SELECT h.doc_id, n, coalesce(max(b), 0), n FROM h LEFT JOIN p ON h.doc_id = p.doc_id GROUP BY h.doc_id, n),
t AS (SELECT k.doc_id, string_agg(substr(x, 2 * start + 1, 2 * (stop - start)), '' ORDER BY a) AS kept FROM k
  JOIN h ON k.doc_id = h.doc_id GROUP BY k.doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans,
  sha256(unhex(any_value(kept))) AS kept_sha256
FROM h JOIN t ON h.doc_id = t.doc_id LEFT JOIN p ON h.doc_id = p.doc_id GROUP BY h.doc_id, n
""",
    "op11_naming": """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS x
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST)
""",
    "op12_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a
    JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (
  SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.r <= 5 AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
    "op13_fim": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS g, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS s FROM d),
f AS (SELECT doc_id, n, t, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g >= 90 THEN 'plain'
    WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""",
}
