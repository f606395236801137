"""Queries over the driver's tables, one an operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, line_dedup, near_dedup, personal_data, quality_rules, sentencepiece_wfst, suffix_dedup, suffix_tree_lm, token_counts, token_store
from tessera.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
s AS (SELECT doc_id, source, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM f) GROUP BY doc_id),
m AS (SELECT s.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines FROM s LEFT JOIN r ON s.doc_id = r.doc_id),
fails AS (SELECT *, n_words < 50 AS f1, n_repeat_words * 100 > 50 * n_words AS f2, n_symbols * 100 > 50 * n_words AS f3, n_dup_lines * 100 > 50 * n_lines AS f4,
             n_words < 60 AS s1, n_repeat_words * 100 > 35 * n_words AS s2, n_symbols * 100 > 25 * n_words AS s3, n_dup_lines * 100 > 35 * n_lines AS s4 FROM m),
hosts AS (SELECT source, count(*) AS n, sum(f1::INT)::DOUBLE AS k1, sum(f2::INT)::DOUBLE AS k2, sum(f3::INT)::DOUBLE AS k3, sum(f4::INT)::DOUBLE AS k4 FROM fails GROUP BY source),
prior AS (SELECT count(*) AS h, sum(n)::DOUBLE AS total, sum(n::DOUBLE * n) AS n2,
                 sum(k1) / sum(n) AS m1, sum(k1 * k1 / n) AS s1, sum(k2) / sum(n) AS m2, sum(k2 * k2 / n) AS s2, sum(k3) / sum(n) AS m3, sum(k3 * k3 / n) AS s3, sum(k4) / sum(n) AS m4, sum(k4 * k4 / n) AS s4 FROM hosts),
rho AS (SELECT *, CASE WHEN m1 * (1 - m1) * (total - n2 / total - (h - 1)) > 1e-9 THEN (s1 - total * m1 * m1 - (h - 1) * m1 * (1 - m1)) / (m1 * (1 - m1) * (total - n2 / total - (h - 1))) ELSE 0 END AS r1,
                 CASE WHEN m2 * (1 - m2) * (total - n2 / total - (h - 1)) > 1e-9 THEN (s2 - total * m2 * m2 - (h - 1) * m2 * (1 - m2)) / (m2 * (1 - m2) * (total - n2 / total - (h - 1))) ELSE 0 END AS r2,
                 CASE WHEN m3 * (1 - m3) * (total - n2 / total - (h - 1)) > 1e-9 THEN (s3 - total * m3 * m3 - (h - 1) * m3 * (1 - m3)) / (m3 * (1 - m3) * (total - n2 / total - (h - 1))) ELSE 0 END AS r3,
                 CASE WHEN m4 * (1 - m4) * (total - n2 / total - (h - 1)) > 1e-9 THEN (s4 - total * m4 * m4 - (h - 1) * m4 * (1 - m4)) / (m4 * (1 - m4) * (total - n2 / total - (h - 1))) ELSE 0 END AS r4 FROM prior),
strength AS (SELECT *, CASE WHEN r1 > 1e-9 THEN greatest(1.0, (1 - r1) / r1) ELSE total END AS t1, CASE WHEN r2 > 1e-9 THEN greatest(1.0, (1 - r2) / r2) ELSE total END AS t2, CASE WHEN r3 > 1e-9 THEN greatest(1.0, (1 - r3) / r3) ELSE total END AS t3, CASE WHEN r4 > 1e-9 THEN greatest(1.0, (1 - r4) / r4) ELSE total END AS t4 FROM rho),
verdict AS (SELECT source, (k1 + m1 * t1) / (n + t1) > 1.5 * m1 AS h1, (k2 + m2 * t2) / (n + t2) > 1.5 * m2 AS h2, (k3 + m3 * t3) / (n + t3) > 1.5 * m3 AS h3, (k4 + m4 * t4) / (n + t4) > 1.5 * m4 AS h4 FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT ((h1 AND s1) OR (h2 AND s2) OR (h3 AND s3) OR (h4 AND s4)) AS kept
FROM fails JOIN verdict ON fails.source IS NOT DISTINCT FROM verdict.source
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.document_hits(decontamination.hit_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.r = places.r LEFT JOIN items ON d.r = items.r
"""


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_documents(token_store.write_shards(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, i, line, common.k IS NOT NULL AND l.doc_id <> holder AS gone FROM l LEFT JOIN common ON l.k = common.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.round_trips(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(read(spark, sf_dir, "documents"))


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scores(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_token_store": op3_token_store,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_near_dedup": op7_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_suffix_tree_lm": op10_suffix_tree_lm,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_near_dedup": OP7_SQL,
}
