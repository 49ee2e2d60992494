"""The corpus operators bound to the tables of a folder: one query per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, langid, mixing, ngram_join, pii, quality, resharding, secrets, tokenfiles, toxicity
from tidelog.llm.shared import table

#: The key of the pseudonyms in the query; a deployment passes its own secret.
KEY = b"tidelog example key"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of pages, whose markup and address give evidence of their own."""
    pages = langid.page_columns(table(spark, sf_dir, "pages"))
    return langid.identify(pages, suffix="suffix").withColumnRenamed("doc_id", "page_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tokenfiles.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.move(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_language_id": op3_language_id,
        "op4_token_files": op4_token_files,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_mixing": op6_mixing,
        "op7_decontamination": op7_decontamination,
        "op8_pseudonyms": op8_pseudonyms,
        "op9_resharding": op9_resharding,
        "op10_toxicity": op10_toxicity,
        "pages_language_id": pages_language_id,
    }


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
marked AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) GROUP BY doc_id),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
raw AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT source, doc_id, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
          len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM raw),
full_lines AS (SELECT source, doc_id, line, sum(n) AS n FROM lines WHERE n > 0 GROUP BY ALL),
common AS (SELECT source, line FROM full_lines JOIN hosts USING (source) GROUP BY source, line, hosts.n HAVING count(*) > 20 AND (count(*) > 0.02 * hosts.n OR count(*) > 5000)),
lost AS (SELECT doc_id, sum(n) AS n, count(*) AS k FROM full_lines JOIN common USING (source, line) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS word_chars,
      length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words,
      coalesce(lost.n, 0) AS gone, coalesce(lost.k, 0) AS gone_lines
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN marked USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(coalesce(word_chars, 0) AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines,
 cast(n_repeat_words AS bigint) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (gone > 0.5 * n_words OR n_words - gone < 10) AS kept,
 cast(gone AS bigint) AS n_removed_words, cast(gone_lines AS bigint) AS n_removed_lines FROM m"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON r.reach = both_ways.a)
SELECT doc_id, cast(n AS bigint) AS n_shingles, min(reach) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n"""

_MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(text, '')) AS key FROM documents),
t AS (SELECT source, sum(size) AS source_size, [5.0::double, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
u AS (SELECT *, 2.0::double * source_size AS cap FROM t),
v AS (SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER q, 0)) AS level FROM u
      WINDOW q AS (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM v WHERE cap / weight >= level) AS common FROM v),
a AS (SELECT source, source_size, CASE WHEN cap / weight < level THEN cap ELSE least(cap, weight * common) END AS target FROM x),
f AS (SELECT *, target / source_size AS rate, cast(floor((target / source_size - floor(target / source_size)) * 268435456.0::double) AS bigint) AS fraction,
      cast('0x' || substr(md5(source || '/42'), 1, 7) AS bigint) AS start FROM a),
k AS (SELECT doc_id, source, key, any_value(size) * count(*) AS size, cast('0x' || substr(md5(doc_id || '/' || key || '/42'), 1, 7) AS bigint) AS draw FROM d GROUP BY doc_id, source, key),
r AS (SELECT doc_id, source, key, row_number() OVER (PARTITION BY source
      ORDER BY lpad(cast(length(bin(size)) AS varchar), 2, '0') || substr(rpad(bin(size), 4, '0'), 1, 4), draw, doc_id, key) - 1 AS place FROM k),
c AS (SELECT doc_id, source, key, source_size, target, least(cast(floor(rate) AS bigint) + ((fraction * (place + 1) + start) >> 28) - ((fraction * place + start) >> 28), 2) AS copies FROM r JOIN f USING (source))
SELECT doc_id, cast(size AS bigint) AS size, cast(source_size AS bigint) AS source_size, target, cast(size * copies AS bigint) AS taken, cast(copies AS bigint) AS copies
FROM d JOIN c USING (doc_id, source, key)"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB, where SQL can express the operator."""
    return {"op2_quality_rules": _QUALITY, "op5_ngram_jaccard_join": _JACCARD, "op6_mixing": _MIXING}
