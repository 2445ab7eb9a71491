"""Exact links between texts whose sets of five-word shingles have a Jaccard similarity of at least 4 / 5.

Words are those of op 4; a text of fewer words has one shingle of them all. Texts of one set are known by its XXH64 and count
as one. The search is a prefix filter and loses nothing: of a set of m, at least ``ceil(4 m / 5)`` shingles are shared with
a similar one, so sets with fewer shingles that any other set has are left out, and two similar sets share one of the
first ``m - ceil(4 m / 5) + 1`` in the order of (number of sets, hash). Sets that share such a one are put into a component
by stars, never by pairs. Within a component, pairs not joined yet are compared exactly, by an index of the unit's rarest
shingles. A component of more than ``UNIT_LIMIT`` shingles is split into parts, sets of one least hash into one part where
they fit. First each part is compared with itself and the next one, which makes one class of a large
group of near copies, whatever its size. Then the sets outside a component's largest class are sent to those other parts
that can hold a partner, and only there: of prefixes longer by l, as below, a partner's part holds at least l hashes. Sets of
the largest class are asked for and need not ask, so what is sent grows with a group's size and not with its square, and weak
links that chain many small classes send nothing.

Most texts are ruled out before that by a longer prefix in the order of hashes alone: of two similar sets' shared shingles
the first l are among the first ``m - ceil(4 m / 5) + l`` of either. With l a tenth of m, at least one, a first round sends
these, three of ten shingles, and goes on with the texts that have a tenth of the least possible partner's size of them in
common with other texts, which a passage or two does not make. Rows are dealt by hash to tell which shingles are shared; a
task that meets a shingle in two texts knows already, deals its rows by text and sends one witness for all of them, so a
shingle that a third of all texts hold brings no task more than about a row a batch. What a shuffle makes is written down, and Spark
removes the shuffle's files when the writing ends.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territory.llm.common import plain, written
from territory.llm.components import connected_components

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction, and the part of a set that the first round's prefixes are longer by.
TOP, BOTTOM, EXTRA = 4, 5, 10
#: Most shingles in one part of a component.
UNIT_LIMIT = 1 << 16
#: Shingles sent to Spark at a time, about, and most names of texts that a task remembers to have sent.
BATCH, SEEN = 1 << 18, 1 << 17
#: Most bytes of names of texts that are broadcast.
BROADCAST_BYTES = 32 << 20
ROWS = "s long, m int, h long"
#: Spark's setting for removing the files of shuffles at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def signature(found: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    h = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _marked(names: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """(s, m, h), once each. A hash that several sets of this batch have has its sizes negative, and one witness of size 0."""
    order = np.lexsort((names, hashes))
    names, sizes, hashes = names[order], sizes[order], hashes[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (names[1:] != names[:-1]))
    names, sizes, hashes = names[new], sizes[new], hashes[new]
    same = hashes[1:] == hashes[:-1]
    before, after = np.append(False, same), np.append(same, False)
    one = after & ~before
    columns = [np.append(names, names[one]), np.append(np.where(before | after, -sizes, sizes), np.zeros(one.sum(), np.int32)), np.append(hashes, hashes[one])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["s", "m", "h"])


def _emitted(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[pa.RecordBatch]:
    """Rows for every hash that ``rows_of`` gives a text as (name, size, hashes), each name once in a while."""
    seen: set[int] = set()
    rows, n = [], 0

    def out() -> pa.RecordBatch:
        size = [len(x) for *_, x in rows]
        return _marked(np.repeat(np.array([s for s, *_ in rows], np.int64), size), np.repeat(np.array([m for _, m, _ in rows], np.int32), size), np.concatenate([x for *_, x in rows]).view(np.int64))

    for b in batches:
        for row in rows_of(b):
            if row[0] in seen or not len(row[2]):
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(row[0])
            rows.append(row)
            n += len(row[2])
            if n >= BATCH:
                yield out()
                rows, n = [], 0
    if rows:
        yield out()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first hashes of the texts, named by the texts' hashes; m is the sets' size."""

    def rows_of(b):
        for t, k in zip(_binaries(b.column(0)), b.column(1).to_pylist(), strict=True):
            x = shingle_set(t)
            yield k, len(x), x[: len(x) - -(-TOP * len(x) // BOTTOM) + -(-len(x) // EXTRA)]

    return _emitted(batches, rows_of)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All hashes of the texts' sets, named by the sets' signatures."""

    def rows_of(b):
        for x in map(shingle_set, _binaries(b.column(0))):
            yield signature(x), len(x), x

    return _emitted(batches, rows_of)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, s, m), once each, those whose h another s has, here or by a mark or a witness; the last row waits
    for the next batch."""
    held, met = None, False
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.append(x, c) for x, c in zip(held, columns, strict=True)]
        s, m, h = columns
        new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (m[1:] != m[:-1]))
        s, m, h = columns = [c[new] for c in columns]
        same = h[1:] == h[:-1]
        hit = np.append(met, same) | (m < 0)
        hit[:-1] |= same
        held, met = [c[-1:] for c in columns], bool(hit[-1])
        go = np.flatnonzero(hit[:-1] & (m[:-1] != 0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s[go], np.abs(m[go]), h[go])], ["s", "m", "h"])
    if met and held[1][0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (held[0], np.abs(held[1]), held[2])], ["s", "m", "h"])


def _told(emitted: DataFrame) -> DataFrame:
    """(s, m, h) of the shingles that several sets have. A row may come twice, marked by one task and not by another."""
    dealt = emitted.repartition(F.when(F.col("m") < 0, F.xxhash64("h", "s")).otherwise(F.col("h")))
    return dealt.sortWithinPartitions("h", "s", "m").mapInArrow(_shared, ROWS)


def unit_links(names: list[int], sizes: list[int], sets: list[np.ndarray], side: list[int], classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the similar sets: of side 0 with side 1, or among all if there is no side 1. A set is
    its shared hashes and its full size; sets of one class are joined already. The prefixes are those of the unit's own order,
    rarest first."""
    own, label = not any(side), np.unique(names if classes is None else classes, return_inverse=True)[1]
    size = np.array(sizes)
    need = -(-TOP * size // BOTTOM)
    every, number, df = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, df))] = np.arange(len(every))
    rank = np.where(df > 1, rank, -1)[number]  # a hash of one set alone joins nothing
    ordered, lo, index, edges = [], 0, defaultdict(list), []
    for x in sets:
        r = rank[lo : lo + len(x)]
        ordered.append(np.sort(r[r >= 0]))
        lo += len(x)
    for i in sorted(range(len(names)), key=lambda i: side[i]):
        prefix = ordered[i][: max(0, len(ordered[i]) - int(need[i]) + 1)].tolist()
        if own or side[i]:
            near = np.unique(np.fromiter(chain.from_iterable(index[h] for h in prefix if h in index), np.int64))
            near = near[(label[near] != label[i]) & (np.minimum(size[near], size[i]) * BOTTOM >= TOP * np.maximum(size[near], size[i]))]
            while len(near):
                j, near = near[0], near[1:]
                both = len(np.intersect1d(ordered[i], ordered[j], assume_unique=True))
                if both * BOTTOM >= TOP * (size[i] + size[j] - both):
                    edges.append((names[i], names[j]))
                    label[label == label[i]] = label[j]
                    near = near[label[near] != label[i]]
        if own or not side[i]:
            for h in prefix:
                index[h].append(i)
    return edges


def _unit(df: pd.DataFrame) -> pd.DataFrame:
    found = unit_links(df["s"].tolist(), df["m"].tolist(), [np.asarray(x, np.int64) for x in df["hs"]], df["side"].tolist(), df["k"].tolist())
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _compared(units: DataFrame) -> DataFrame:
    """Edges of the units of (c, u, v)."""
    return units.select("c", "u", "v", "side", "s", "k", "m", "hs").repartition("c", "u", "v").groupBy("c", "u", "v").applyInPandas(_unit, "a long, b long")


def _written(df: DataFrame) -> DataFrame:
    """The rows, written down; the files of the shuffles behind them are removed when that is done."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df)
    finally:
        conf.set(CLEANUP, before)


def _need() -> Column:
    """The least number of shingles that a set shares with a similar one."""
    return F.ceil(F.col("m") * TOP / BOTTOM).cast("int")


def _prefix(longer: Column) -> Column:
    return F.slice("hs", F.lit(1), F.col("n") - _need() + longer)


def _least() -> Column:
    """A partner of m shingles or more than 4 m / 5 of them has a prefix that is longer by at least a tenth of that."""
    return F.ceil(_need() / EXTRA)


def routes(member: DataFrame, outside: DataFrame) -> DataFrame:
    """(s, at): the parts that can hold sets similar to those outside; of each set's own part and the ones beside it the links
    are known. Sets of m and more than 4 m / 5 shingles share the first tenth of that, at least, of the shingles in common
    within prefixes that are longer by a tenth of their sizes."""
    longer = _prefix(F.ceil(F.col("m") / EXTRA).cast("int"))
    held = member.select("c", F.explode(longer).alias("h"), F.col("p").alias("at")).distinct()
    asking = outside.select("c", "s", "m", "p", F.explode(longer).alias("h"))
    met = asking.join(plain(held, "c", "h"), ["c", "h"]).where("abs(p - at) > 1")
    return met.groupBy("s", "m", "at").agg(F.count("*").alias("n")).where(F.col("n") >= _least()).select("s", "at")


def similar_links(texts: DataFrame, unit_limit: int = UNIT_LIMIT) -> DataFrame:
    """Edges (a, b) between the signatures of column ``t``'s sets, whose components are those of all similar pairs."""
    texts = texts.select("t", F.xxhash64("t").alias("k"))
    near = _written(_told(texts.mapInArrow(_prefixes, ROWS)).groupBy("s", "m").agg(F.count("*").alias("n")).where(F.col("n") >= _least()).select("s"))
    near = F.broadcast(near) if near.count() * 16 <= BROADCAST_BYTES else near.hint("shuffle_hash")
    shared = _written(_told(texts.join(near, F.col("k") == F.col("s"), "left_semi").select("t").mapInArrow(_exploded, ROWS)))
    enough = F.col("n") * BOTTOM >= F.col("m") * TOP
    able = shared.groupBy("s", "m").agg(F.count("*").alias("n")).where(enough).select("s")
    left = _written(shared.join(plain(able, "s"), "s", "left_semi"))
    held = left.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    listed = left.join(plain(held, "h"), "h").groupBy("s", "m").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("x"))
    sets = _written(listed.withColumn("n", F.size("x")).where(enough).select("s", "m", "n", F.transform("x", lambda v: v["h"]).alias("hs")))
    prefix = sets.select("s", F.explode(_prefix(F.lit(1))).alias("h"))
    star = prefix.join(plain(prefix.groupBy("h").agg(F.min("s").alias("low")), "h"), "h").select("s", "low")
    component = connected_components(star, "s", "low").select(F.col("node").alias("s"), F.col("component").alias("c"))
    ids = _written(sets.select("s", "n", F.array_min("hs").alias("g")).join(component, "s"))
    full = ids.groupBy("c").agg(F.sum("n").alias("all")).where(F.col("all") > unit_limit).select("c", F.ceil(F.col("all") / unit_limit).cast("int").alias("parts"))
    split = ids.groupBy("c", "g").agg(F.sum("n").alias("w")).where(F.col("w") * 2 > unit_limit).select("c", "g", F.lit(True).alias("split"))
    dealt_by = F.when(F.col("split"), F.col("s")).otherwise(F.col("g"))
    located = ids.join(plain(full, "c"), "c", "left").join(plain(split, "c", "g"), ["c", "g"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = _written(sets.join(located.select("s", "c", "parts", F.pmod(F.xxhash64(dealt_by), F.col("parts")).cast("int").alias("p")), "s"))
    # A unit u holds the parts u and u + 1.
    ends = F.array_distinct(F.array(F.greatest(F.col("p") - 1, F.lit(0)), F.least("p", F.greatest(F.col("parts") - 2, F.lit(0)))))
    edges = _written(_compared(parted.select("c", F.explode(ends).alias("u"), F.lit(0).alias("v"), F.lit(0).alias("side"), "s", F.col("s").alias("k"), "m", "hs")))
    large = parted.where("parts > 2")
    if large.isEmpty():
        return edges
    classes = connected_components(edges)
    member = _written(large.join(classes, F.col("s") == F.col("node"), "left").select("c", "p", "s", "m", "n", "hs", F.coalesce("component", "s").alias("k")))
    most = member.groupBy("c", "k").agg(F.sum("n").alias("w")).groupBy("c").agg(F.max_by("k", "w").alias("largest"))
    outside = member.join(plain(most, "c"), "c").where("k <> largest").drop("largest")
    sent = _written(outside.drop("p").join(routes(member, outside), "s"))
    sizes = sent.groupBy("c", F.col("at").alias("p")).agg(F.ceil(F.sum("n") / unit_limit).cast("int").alias("others"))
    asked = member.join(plain(sizes, "c", "p"), ["c", "p"]).select("c", F.col("p").alias("u"), F.explode(F.expr("sequence(0, others - 1)")).alias("v"), F.lit(0).alias("side"), "s", "k", "m", "hs")
    asking = sent.withColumnRenamed("at", "p").join(plain(sizes, "c", "p"), ["c", "p"]).select("c", F.col("p").alias("u"), F.pmod(F.xxhash64("s"), F.col("others")).cast("int").alias("v"), F.lit(1).alias("side"), "s", "k", "m", "hs")
    return edges.unionAll(_compared(asked.unionAll(asking)))
