"""Op 6. Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Defined results for odd rows: a null or empty text has no words, so
every count is 0, every ratio is null, ``base_failed`` is true and ``kept`` false. Repeated rows are judged one by one. The
operator reads the id and text columns alone and passes every other column on; a column named like one of its results is
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.common import WS_CHARS, let

#: Common function words of the four languages, compared after trailing commas and full stops are cut, in their own case.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf auch das dem den der des die ein eine für im ist mit nicht sich und von werden zu "
    "au avec dans de elle en est et il la le les par pas pour que qui sur un une "
    "al como con del el las lo los no para por se su y"
).split()


class Rule(NamedTuple):
    """A text passes if the metric lies within [low, high]; None leaves a side open."""

    metric: str
    low: float | None
    high: float | None


#: The threshold table. The base rules (50 words, repeated words) stand apart, in ``base_failed``.
THRESHOLDS = (
    Rule("mean_word_chars", 2.5, 10.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("stop_word_share", 0.05, None),
    Rule("dup_line_share", None, 0.6),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SQL_WS = "".join({"\t": "\\t", "\n": "\\n", "\r": "\\r", " ": " "}.get(c, f"\\u{ord(c):04x}") for c in WS_CHARS)
_BLANKS = r"[ \\t-\\r]+"
_SYMBOLS = "[#*$%&|<>]"
#: The lines that hold a word.
_LINES = f"filter(split(t, '\\n'), l -> trim(BOTH '{_SQL_WS}' FROM l) <> '')"

#: Words covered by 3-word windows that occur twice or more. ``hs`` has the windows' 64-bit hashes in order. ``v`` keeps the words
#: in one evaluation, even where a filter on the results is pushed below their projection.
_REPEATS = let("v", "ws", let(
    "hs",
    "if(size(v) < 3, cast(array() as array<bigint>), transform(sequence(0, size(v) - 3), i -> xxhash64(v[i], v[i + 1], v[i + 2])))",
    "if(size(hs) = size(array_distinct(hs)), 0, "
    + let(
        "s",
        "sort_array(transform(hs, (h, i) -> struct(h as h, i as i)))",
        let(
            "p",
            "transform(filter(sequence(0, size(s) - 1), k -> (k > 0 and s[greatest(k - 1, 0)].h = s[k].h) or s[least(k + 1, size(s) - 1)].h = s[k].h and k < size(s) - 1), k -> s[k].i)",
            "size(array_union(array_union(p, transform(p, x -> x + 1)), transform(p, x -> x + 2)))",
        ),
    )
    + ")",
))


def compile_rules(rules=THRESHOLDS) -> str:
    """One boolean SQL expression of the threshold table; a ratio that is null fails."""
    parts = []
    for r in rules:
        if r.low is not None:
            parts.append(f"{r.metric} >= {r.low}D")
        if r.high is not None:
            parts.append(f"{r.metric} <= {r.high}D")
    return "coalesce(" + " and ".join(parts or ["true"]) + ", false)"


def judge(docs: DataFrame, text: str = "text", rules=THRESHOLDS, stop_words=STOP_WORDS) -> DataFrame:
    """The rows with their counts, ratios, ``base_failed`` and ``kept``."""
    ratio = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbols_per_word": "n_symbols / nullif(n_words, 0)",
        "stop_word_share": "n_stop_words / nullif(n_words, 0)",
        "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    }
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
    count = {
        "n_words": "size(ws)",
        "word_chars": "char_length(array_join(ws, ''))",
        "n_symbols": f"regexp_count(t, '{_SYMBOLS}')",
        "n_dup_lines": "size(ls) - size(array_distinct(ls))",
        "n_repeat_words": _REPEATS,
        "n_stop_words": f"size(filter(ws, w -> rtrim('.,', w) in ({stops})))",
        "n_lines": "size(ls)",
    }
    out = [*count, *ratio, "base_failed", "kept"]
    kept = [c for c in docs.columns if c not in out]
    # The other columns are packed away, so that none of theirs is taken for one of these; words and lines are split once.
    row = F.struct(*(F.col(f"`{c}`") for c in kept), F.lit(None).alias("")).alias("row")
    split = docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).withColumn("ws", F.expr(f"array_remove(split(t, '{_BLANKS}'), '')")).withColumn("ls", F.expr(_LINES))
    counted = split.select("row", *(F.expr(v).cast("long").alias(k) for k, v in count.items())).withColumns({k: F.expr(v) for k, v in ratio.items()})
    failed = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    return counted.withColumn("base_failed", F.expr(failed)).withColumn("kept", F.expr(f"not base_failed and {compile_rules(rules)}")).select(*(F.col(f"row.`{c}`").alias(c) for c in kept), *out)


def keep(docs: DataFrame, text: str = "text", rules=THRESHOLDS, stop_words=STOP_WORDS) -> DataFrame:
    """The rows that pass every rule, with exactly the columns they came with, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("__text"))
    # A generator, not a filter: that would be pushed below the projections and count everything twice.
    return judge(packed, "__text", rules, stop_words).select(F.inline(F.expr("if(kept, array(__row), null)")))


def oracle_sql(rules=THRESHOLDS, stop_words=STOP_WORDS) -> str:
    """DuckDB SQL of the query's rows."""
    ws = r"[\x20\x09-\x0D]"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
    tests = " AND ".join([f"{r.metric} >= {r.low}" for r in rules if r.low is not None] + [f"{r.metric} <= {r.high}" for r in rules if r.high is not None])
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM t),
g AS (SELECT doc_id, pos, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (rtrim(word, '.,') IN ({stops})) AS n_stop FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(n_lines, 0) AS n_lines
  FROM t LEFT JOIN ws USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN covered USING (doc_id)),
x AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word, n_stop / nullif(n_words, 0) AS stop_word_share, n_dup_lines / nullif(n_lines, 0) AS dup_line_share, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce({tests}, false)) AS kept FROM x"""
