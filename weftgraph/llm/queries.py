"""Queries of this subpackage: one opN_<name> for each operator, on its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ctw, decontam, langcrf, packing, pii, riskrules, simhash, tokenbin, unitdedup, warc
from .common import table


def op1_lm_scoring(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_ids(spark, sf_dir):
    return tokenbin.round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_language_id(spark, sf_dir):
    return langcrf.identify(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return unitdedup.dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark, sf_dir):
    return riskrules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("op") and k[2].isdigit()}
ORACLES: dict[str, str] = {}

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, (i // 4) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '')"
ORACLES["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), f AS (SELECT s, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (s)"""

_MEASURES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "upper / greatest(word_chars, 1)", "mean_word": "word_chars / greatest(n_words, 1)",
}
_HIT = ", ".join(f"len(list_filter({cuts!r}, lambda c: {_MEASURES[m]} <= c))" for m, cuts in riskrules.SETTINGS.items())
_ALPHA = riskrules.LIMIT
ORACLES["op8_quality_rules"] = f"""
WITH a AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(string_split_regex(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines FROM a),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x, unnest(range(1, len(w) - 6)) AS i FROM b),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n FROM (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS step FROM twice) GROUP BY 1),
m AS (SELECT b.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, coalesce(rep.n, 0) AS n_repeat_words FROM b LEFT JOIN rep ON rep.doc_id = b.doc_id),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, least({_HIT}) AS hit FROM m),
g AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id),
k AS (SELECT stratum, j, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND hit <= j) AS k, count(*) FILTER (q = 0 AND hit <= j) AS bad
  FROM c JOIN g USING (doc_id), range({riskrules.STEPS}) AS s(j) WHERE NOT base_failed GROUP BY 1, 2),
ok AS (SELECT stratum, j, bad FROM k WHERE n > 0 AND k <= n * {_ALPHA!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA!r}) + (n - i) * ln(1 - {_ALPHA!r}))))
  <= {riskrules.DELTA!r} * n / (SELECT sum(n) FROM k WHERE j = 0)),
chosen AS (SELECT stratum, CAST(min(j) AS INTEGER) AS setting FROM ok WHERE bad = (SELECT max(bad) FROM ok AS o WHERE o.stratum = ok.stratum) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(hit <= setting, false) AS kept, setting FROM c LEFT JOIN chosen USING (stratum)"""
