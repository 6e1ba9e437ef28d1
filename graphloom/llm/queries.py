"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, common, decontamination, license_scan, line_dedup, lm_scoring, pii, quality_classifier, quality_rules, sharding, simhash
from graphloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})


#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    spec = bpe.load_spec(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.json")
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), spec)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    spec = bpe.load_spec(vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), spec)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("hits")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.balanced_tree(16)
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), tree, sharding.grown_tree(tree, 16))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_bpe, op3_quality_rules, op4_pii, op5_quality_classifier, op6_lm_scoring, op7_simhash, op8_license_scan, op9_sharding, op10_decontamination)}


_LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM e),
s AS (SELECT doc_id, i, s, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM t WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, k, concat_ws(chr(10), s, s1, s2) AS key FROM s WHERE k = 0 OR k <= n - 3),
f AS (SELECT key, min((doc_id, k)) AS first FROM w GROUP BY key HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, k + d AS k FROM w JOIN f USING (key), (VALUES (0), (1), (2)) v(d) WHERE (doc_id, k) <> first),
g AS (SELECT s.doc_id, s.i, s.k, c.k IS NOT NULL AS gone FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.k = s.k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM g GROUP BY doc_id),
m AS (SELECT t.doc_id, t.i, t.line, greatest(count(g.i) OVER (PARTITION BY t.doc_id ORDER BY t.i) - 1, 0) AS k FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i),
x AS (SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.i) AS text FROM m LEFT JOIN g ON g.doc_id = m.doc_id AND g.k = m.k WHERE NOT coalesce(g.gone, false) GROUP BY m.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text WHEN n_removed = n_lines THEN '' ELSE x.text END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id)
"""

_MEASURES_SQL = ", ".join(f"({c} + 0.5) / (n_words + 1)::DOUBLE AS {m}" for m, c in quality_rules.MEASURES.items())
_TWO_SIDED_SQL = ", ".join(f"'{m}'" for m in quality_rules.TWO_SIDED)
_QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM q WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
dup AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l) z WHERE k > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.lang, d.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words
  FROM documents d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
v AS (SELECT *, {_MEASURES_SQL} FROM m),
u AS (UNPIVOT (SELECT doc_id, lang, source, {", ".join(quality_rules.MEASURES)} FROM v) ON {", ".join(quality_rules.MEASURES)} INTO NAME measure VALUE x),
b AS (SELECT lang, source, measure, ceil(ln(x) / {common.LOG_GAMMA!r}) AS bucket, count(*) AS n FROM u GROUP BY ALL),
own AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM b),
both_ AS (SELECT lang, measure, bucket, sum(n) AS n FROM b GROUP BY ALL),
wide AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY lang, measure) AS total FROM both_),
oq AS (SELECT lang, source, measure, max(total) AS total, min(bucket) FILTER (WHERE cum >= greatest(1.0, 0.25 * total)) AS b1, min(bucket) FILTER (WHERE cum >= greatest(1.0, 0.75 * total)) AS b3 FROM own GROUP BY ALL),
wq AS (SELECT lang, measure, min(bucket) FILTER (WHERE cum >= greatest(1.0, 0.25 * total)) AS b1, min(bucket) FILTER (WHERE cum >= greatest(1.0, 0.75 * total)) AS b3 FROM wide GROUP BY ALL),
z AS (SELECT oq.lang, oq.source, oq.measure, CASE WHEN total < {quality_rules.MIN_TEXTS} THEN wq.b1 ELSE oq.b1 END AS b1, CASE WHEN total < {quality_rules.MIN_TEXTS} THEN wq.b3 ELSE oq.b3 END AS b3
  FROM oq JOIN wq ON oq.lang = wq.lang AND oq.measure = wq.measure),
h AS (SELECT u.doc_id, string_agg(u.measure, ',' ORDER BY list_position({list(quality_rules.MEASURES)!r}, u.measure)) AS failed FROM u JOIN z ON z.lang = u.lang AND z.source = u.source AND z.measure = u.measure
  WHERE ln(x) > (b3 + {quality_rules.FENCE} * (b3 - b1 + 1)) * {common.LOG_GAMMA!r} OR u.measure IN ({_TWO_SIDED_SQL}) AND ln(x) < (b1 - 1 - {quality_rules.FENCE} * (b3 - b1 + 1)) * {common.LOG_GAMMA!r} GROUP BY u.doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(failed, '') AS failed, lang, source,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed IS NULL AS kept
FROM m LEFT JOIN h USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """For the operators whose rules SQL can express. The hashes, trained models and vocabularies of the others it can't; tests compare them with plain versions."""
    return {"op1_line_dedup": _LINE_DEDUP_SQL, "op3_quality_rules": _QUALITY_SQL}
