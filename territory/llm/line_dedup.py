"""Op 9. Line dedup over overlapping three-line windows, in DataFrame operations only.

A text's lines (split at ``\\n``) that are not blank are hashed, trimmed, three at a time; a window is known by 128 bits. A
text of one or two such lines is one window of them all. Of every window that occurs more than once in the corpus the first
occurrence, by (id, text hash, line), stays; the lines of all later ones are removed, windows that overlap being merged
into the lines they cover. A line's own first occurrence is never covered by a later window, so no line's content is lost
from the corpus.

Shuffles. Windows (hashes and numbers, no text) are made once and written down. They are counted with map-side partial
aggregation, so a passage in a third of all rows costs one row a task. The hashes found more than once, with their first
occurrences, are dealt anew before the join with the windows: both its sides are then plain exchanges, and Spark splits the
hot keys of the windows' side. The texts do not move while what is removed from them is at
most ``BROADCAST_BYTES``, which is measured before each broadcast; beyond that they move once, to a hash join that sorts no
text. Both ways give the same rows.

Defined results: a null text stays null; texts of blank lines alone have no window and stay; rows with equal id and text
are one document and get the same result each; a null id orders first; blank lines stay; a text whose every line goes is
empty; other columns pass, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.common import WS_CHARS, let, plain, written

#: Most bytes of removed lines' numbers that are broadcast.
BROADCAST_BYTES = 32 << 20

_WS = "".join({"\t": "\\t", "\n": "\\n", "\r": "\\r", " ": " "}.get(c, f"\\u{ord(c):04x}") for c in WS_CHARS)
_LINES = f"filter(transform(split(__text, '\\n'), l -> trim(BOTH '{_WS}' FROM l)), l -> l <> '')"
_WINDOWS = let(
    "a",
    _LINES,
    "if(size(a) = 0, null, transform(sequence(0, greatest(size(a) - 3, 0)), k -> struct("
    "xxhash64(a[k], coalesce(get(a, k + 1), ''), coalesce(get(a, k + 2), '')) as h1, xxhash64('w', coalesce(get(a, k + 2), ''), a[k], coalesce(get(a, k + 1), '')) as h2, k as k)))",
)
#: The numbers of the lines that the windows ``__at`` cover.
_GONE = let(
    "full",
    f"filter(sequence(0, size(split(__text, '\\n')) - 1), i -> trim(BOTH '{_WS}' FROM split(__text, '\\n')[i]) <> '')",
    "array_distinct(flatten(transform(__at, k -> slice(full, k + 1, 3))))",
).replace("split(__text, '\\n')", "__lines")
_KEPT = "array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i]), '\\n')"


def windows(docs: DataFrame) -> DataFrame:
    """(__id, __key, h1, h2, k): every window of every text; k counts the lines that are not blank."""
    return docs.select("__id", "__key", F.expr(f"inline({_WINDOWS})"))


def removed_windows(docs: DataFrame) -> DataFrame:
    """(__id, __key, __at): the later occurrences of windows, of the texts that have any."""
    every = written(windows(docs))
    first = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__key", "k")).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = every.join(plain(first, "h1"), ["h1", "h2"]).where("not (first <=> struct(__id, __key, k))")
    return later.groupBy("__id", "__key").agg(F.collect_set("k").alias("__at"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", count: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with the text's repeated lines removed; ``count`` names an added column of how many were."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("__row") if len(docs.columns) > 1 else F.lit(None).alias("__row")
    keyed = docs.select(row, F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__text"), F.xxhash64(f"`{id_col}`", f"`{text}`").alias("__key"))
    gone = written(removed_windows(keyed.select("__id", "__key", "__text")))
    size = gone.agg(F.count("*") * 64 + F.coalesce(F.sum(F.size("__at")), F.lit(0)) * 8).first()[0]
    gone = gone.select(F.col("__id").alias("__gid"), F.col("__key").alias("__gkey"), "__at")
    gone = F.broadcast(gone) if size <= broadcast_bytes else gone.hint("shuffle_hash")
    met = keyed.join(gone, (F.col("__key") == F.col("__gkey")) & F.col("__id").eqNullSafe(F.col("__gid")), "left")
    met = met.withColumn("__lines", F.when(F.col("__at").isNotNull(), F.split("__text", "\n")))
    met = met.withColumn("__gone", F.when(F.col("__at").isNotNull(), F.expr(_GONE)))
    kept = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.expr(_KEPT)).alias(text)
    out = [kept if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return met.select(*out, *([F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias(count)] if count else []))


def oracle_ctes(source: str = "documents", p: str = "") -> str:
    """DuckDB CTEs that end in ``{p}deduped`` (doc_id, text, n_removed); ids are unique there."""
    ws = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)
    return f"""{p}lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
{p}full_lines AS (SELECT doc_id, i, trim(raw, {ws}) AS l FROM {p}lines WHERE trim(raw, {ws}) <> ''),
{p}win AS (SELECT doc_id, i AS i0, lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2, l AS l0, lead(l, 1) OVER o AS l1, lead(l, 2) OVER o AS l2, row_number() OVER o AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM {p}full_lines WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
{p}ranked AS (SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, i0) AS rn FROM {p}win WHERE i2 IS NOT NULL OR (n < 3 AND r = 1)),
{p}gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest([i0, i1, i2]) AS i FROM {p}ranked WHERE rn > 1) WHERE i IS NOT NULL),
{p}rebuilt AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS text FROM {p}lines ANTI JOIN {p}gone USING (doc_id, i) GROUP BY doc_id),
{p}counts AS (SELECT doc_id, count(*) AS n FROM {p}gone GROUP BY doc_id),
{p}deduped AS (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(c.n, 0)::BIGINT AS n_removed FROM {source} d LEFT JOIN {p}rebuilt r USING (doc_id) LEFT JOIN {p}counts c USING (doc_id))"""


def oracle_sql() -> str:
    return f"WITH {oracle_ctes()} SELECT doc_id, n_removed, text FROM deduped"
