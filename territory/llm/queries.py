"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm import decontamination, divergence, html_extract, line_dedup, piece_codec, pii, quality_rules, resampling, secret_scan, simhash_dedup, token_counts, toxicity, url_filters
from territory.llm.common import table
from territory.llm.components import connected_components

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", simhash_dedup.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents", "doc_id", "text")).drop("n_format")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"), count="n_removed").select("doc_id", "n_removed", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every contaminated document: the items it holds passages of, and where."""
    found = decontamination.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).where("size(matches) > 0")
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["item"], m["start"], m["end"])), ",")
    return found.select("doc_id", F.lit(True).alias("contaminated"), items.alias("item_ids"), spans.alias("spans"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


# Parts of the operators that SQL can express


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5's counts of base spans."""
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *(f"n_{k}" for k in pii.KINDS))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7's counts of base spans."""
    return secret_scan.find(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *(f"n_{k}" for k in secret_scan.KINDS))


#: Values that stand for fingerprints: of equal remainder mod 97 they differ in their six last bits, else in many more.
_VALUES = "(doc_id % 97) * 2654435761 * 64 + doc_id % 64"


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4's links and components of given values."""
    fps = table(spark, sf_dir, "documents", "doc_id").selectExpr(f"{_VALUES} as fp").distinct()
    found = connected_components(simhash_dedup.links(fps))
    return fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_PII_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ips AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS x FROM t),
cards AS (SELECT doc_id, {_DIGITS} AS d FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+')) AS x FROM t)),
phones AS (SELECT doc_id, {_DIGITS} AS d FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]')) AS x FROM t)),
luhn AS (SELECT doc_id, d, list_sum([CASE WHEN i % 2 = 0 THEN substr(d, (length(d) - i)::BIGINT, 1)::INTEGER WHEN substr(d, (length(d) - i)::BIGINT, 1)::INTEGER > 4 THEN 2 * substr(d, (length(d) - i)::BIGINT, 1)::INTEGER - 9 ELSE 2 * substr(d, (length(d) - i)::BIGINT, 1)::INTEGER END FOR i IN range(length(d))]) AS total FROM cards WHERE length(d) BETWEEN 12 AND 19),
i AS (SELECT doc_id, count(*) AS n FROM ips WHERE len([p FOR p IN string_split(x, '.') IF length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255]) = 0 GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM luhn WHERE total % 10 = 0 GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n FROM phones WHERE length(d) BETWEEN 9 AND 15 GROUP BY doc_id)
SELECT t.doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email, coalesce(i.n, 0)::BIGINT AS n_ip, coalesce(c.n, 0)::BIGINT AS n_card, coalesce(p.n, 0)::BIGINT AS n_phone
FROM t LEFT JOIN i USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)"""
_SECRET_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len([x FOR x IN regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2) IF length(x) >= 12])::BIGINT AS n_assign,
  len([x FOR x IN regexp_extract_all(t, 'AKIA[A-Z0-9]+') IF length(x) >= 18])::BIGINT AS n_access, len([x FOR x IN regexp_extract_all(t, '[0-9a-f]+') IF length(x) >= 16])::BIGINT AS n_hex
FROM t"""
_NEAR_SQL = f"""
WITH RECURSIVE v AS (SELECT DISTINCT {_VALUES} AS fp FROM documents),
near AS (SELECT a.fp AS a, b.fp AS b FROM v a JOIN v b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3),
walk(a, b) AS (SELECT a, b FROM near UNION SELECT walk.a, near.b FROM walk JOIN near ON walk.b = near.a)
SELECT fp, least(fp, coalesce(min(b), fp)) AS component FROM v LEFT JOIN walk ON fp = a GROUP BY fp"""


def queries() -> dict[str, Query]:
    every = (op1_url_filters, op2_html_extraction, op3_piece_codec, op4_simhash_dedup, op5_pii, op6_quality_rules, op7_secret_scans, op8_toxicity, op9_line_dedup, op10_decontamination, op11_resampling, op12_token_counts, op13_divergence, pii_base_counts, secret_base_counts, near_fingerprints)
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"op1_url_filters": url_filters.oracle_sql(), "op6_quality_rules": quality_rules.oracle_sql(), "op9_line_dedup": line_dedup.oracle_sql(), "op11_resampling": resampling.oracle_sql(), "op13_divergence": divergence.oracle_sql()}
    return own | {"pii_base_counts": _PII_SQL, "secret_base_counts": _SECRET_SQL, "near_fingerprints": _NEAR_SQL}
