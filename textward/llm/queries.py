"""The queries of these operators over the shared tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import ann, bpe, langid, line_dedup, minhash, packing, quality, rules, secrets, suffix_dedup
from textward.session import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return packing.pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.learn(documents))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.learn(documents, table(spark, sf_dir, "labels")))


QUERIES = {"op1_bpe": op1_bpe, "op2_secrets": op2_secrets, "op3_ann": op3_ann, "op4_packing": op4_packing, "op5_langid": op5_langid, "op6_quality": op6_quality, "op7_suffix": op7_suffix, "op8_minhash": op8_minhash, "op9_lines": op9_lines, "op10_rules": op10_rules}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Exact definitions, over whole tables; the other operators learn, or choose among equals, and are tested by hand.
ORACLE_SQL: dict[str, str] = {
    "op7_suffix": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM t WHERE n >= 100)),
f AS (SELECT x, min(doc_id::HUGEINT * 4294967296 + s) AS first FROM w GROUP BY x HAVING count(*) > 1),
r AS (SELECT w.doc_id, s FROM w JOIN f USING (x) WHERE w.doc_id::HUGEINT * 4294967296 + s <> first),
g AS (SELECT doc_id, s, sum(CASE WHEN s - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT *, lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM r)),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM cut JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
    "op8_minhash": f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS x FROM t),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (n + m - c)),
reach(id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, len(x)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM s JOIN reach ON id = doc_id GROUP BY doc_id, x""",
}
