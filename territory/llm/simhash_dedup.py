"""Op 4. SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

A text's A-Z are lower-cased, its words are ``[^\\x20\\x09-\\x0D]+``, its shingles three words joined by a space, repeats
included; fewer words give one shingle of them all, none (or null) gives fingerprint zero, which links like any other. A
fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42).

Linking. Two fingerprints within radius r agree on at least ``blocks - r`` of ``blocks`` bit blocks, so every pair meets in
a shard that is named by the blocks agreed on; the loss is none. Each shard's distinct fingerprints are built into a
BK-tree, whose children hang on the integer Hamming distance to their parent, and a search follows only the edges within
the radius. Trees live where their shard is shuffled to instead of being broadcast: all the trees together grow with the
corpus and have no size bound. A shard of more than ``tree_limit`` fingerprints is split into parts; each pair of parts is
a unit of its own (the tree of one, searched for the other's rows), so no task holds an unbounded shard. A unit returns the
stars of its components, at most one edge a fingerprint, from which distributed star rounds make the components. How many
blocks there are follows the number of fingerprints: it changes the plan and never the links.

Copies share a fingerprint and are counted once; the classes are dealt anew before the copies meet them, so that Spark splits
the copies of one fingerprint among tasks. Defined results: a row with a null id takes part and gets its group's
smallest id; repeated rows stay repeated; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.common import cut, plain, written
from territory.llm.components import connected_components
from territory.llm.shingle_links import shingle_set, signature, similar_links

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Most fingerprints in one BK-tree.
TREE_LIMIT = 32_768
#: Most bytes of names of rows that leave, with which the texts stay where they are.
BROADCAST_BYTES = 32 << 20
#: Links of a value that are joined one by one, more of them by their labels.
FEW = 8
#: Searches of fewer rows than this go down the tree one by one, larger ones together.
SMALL = 24


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, named: bool = False) -> DataFrame:
    """(id, key, fp long) of every row, key a hash of id and text; with ``named`` also s, the signature of its set of five-word
    shingles."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.large_binary() if pa.types.is_large_string(b.column(2).type) else pa.binary())
            texts = texts.to_pylist()
            made = [pa.array((fingerprint(t, size) for t in texts), pa.int64())]
            if named:
                made.append(pa.array((signature(shingle_set(t)) for t in texts), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["id", "key", "fp", "s"][: 2 + len(made)])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{id_col}`", f"`{text}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))
    return source.mapInArrow(run, f"id {kind.simpleString()}, key long, fp long" + ", s long" * named)


class BKTree:
    """A BK-tree of distinct 64-bit values: node i has ``value[i]`` and children by distance."""

    def __init__(self, values: list[int]) -> None:
        self.value, self.children = values, [{} for _ in values]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                d = (v ^ values[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    break
                at = below

    def near(self, v: int, radius: int) -> list[int]:
        """Nodes within the radius of one value."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (v ^ self.value[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if -radius <= k - d <= radius]
        return found

    def near_all(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, rows of ``values`` within the radius), the rows going down the tree together."""
        todo = [(0, np.arange(len(values)))] if self.value and len(values) else []
        while todo:
            at, rows = todo.pop()
            d = np.bitwise_count(values[rows] ^ np.uint64(self.value[at]))
            hit = rows[d <= radius]
            if len(hit):
                yield at, hit
            for k, c in self.children[at].items():
                go = rows[(d <= k + radius) & (d + radius >= k)]
                if len(go):
                    todo.append((c, go))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning_links(tree: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (values) with the components of the links between a part's tree and other rows, or among the tree's own if
    there are no other rows: from each value to the smallest of its component, so that rounds over all units are few."""
    nodes = np.unique(tree)
    seek = np.unique(rows) if len(rows) else nodes
    every = np.union1d(nodes, seek)
    bk, node_at, seek_at = BKTree(nodes.tolist()), np.searchsorted(every, nodes).tolist(), np.searchsorted(every, seek)
    label = np.arange(len(every))
    forest = Forest(len(every))
    if len(seek) < SMALL:
        hits = ((n, np.array([i])) for i, v in enumerate(seek.tolist()) for n in bk.near(v, radius))
    else:
        hits = bk.near_all(seek, radius)
    for n, found in hits:
        if len(found) <= FEW:
            for i in seek_at[found].tolist():
                forest.join(node_at[n], i)
            continue
        met = np.append(seek_at[found], node_at[n])
        known = np.unique(label[met])  # values of one label are joined already: a dense unit costs a join a label, not a link
        for x in known[1:].tolist():
            forest.join(int(known[0]), x)
        label[met] = forest.top(int(known[0]))
    top = np.fromiter(map(forest.top, range(len(every))), np.int64, len(every))
    far = np.flatnonzero(top != np.arange(len(every)))
    return every[far], every[top[far]]


def _blocks_for(n: int) -> int:
    """More and longer shard names as the corpus grows, for shards that stay small; any number loses nothing."""
    return 4 if n <= 1 << 22 else 5 if n <= 1 << 28 else 6


def _shard_names(blocks: int, radius: int) -> list[tuple[int, int]]:
    """(table, mask): the bits that must agree."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [(t, sum(masks[i] for i in c)) for t, c in enumerate(combinations(range(blocks), blocks - radius))]


def _units(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by unit and side; runs of a unit that go over several batches are put together."""

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        keys, fp, side = df[["k", "t", "i", "j"]].to_numpy(), df["fp"].to_numpy().astype(np.int64).view(np.uint64), df["side"].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if hi - lo > 1:
                s = side[lo:hi] == 0
                x, y = spanning_links(fp[lo:hi][s], fp[lo:hi][~s], radius)
                a.append(x)
                b.append(y)
        cat = lambda p: np.concatenate(p).view(np.int64) if p else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(a), "b": cat(b)})

    rest: pd.DataFrame | None = None
    for df in batches:
        if rest is not None and len(rest):
            df = pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        same = (df[["k", "t", "i", "j"]] == df[["k", "t", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        done = len(df) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = df.iloc[done:]
        if done:
            yield solve(df.iloc[:done])
    if rest is not None and len(rest):
        yield solve(rest)


def links(fps: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct values of column ``fp``."""
    blocks = blocks or max(radius + 1, _blocks_for(fps.count()))
    names = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in _shard_names(blocks, radius)))
    sharded = fps.select("fp", F.inline(names))
    full = sharded.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > tree_limit).select("t", "k", F.ceil(F.col("n") / tree_limit).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = sharded.join(plain(full, "t", "k"), ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", part)
    units = placed.select("fp", "t", "k", "p", F.explode(F.expr("sequence(0, parts - 1)")).alias("q")).select(
        "t", "k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"), "fp"
    )
    dealt = units.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "side")
    return dealt.mapInPandas(partial(_units, radius=radius), "a long, b long")


def _set_edges(ids: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Edges (a, b) that join the fingerprints of texts with similar sets of five-word shingles, or the same set."""
    sets = connected_components(similar_links(docs.select(F.col(text).cast("string").alias("t"))))
    pairs = ids.select("fp", "s").distinct().join(sets, F.col("s") == F.col("node"), "left").select("fp", F.coalesce("component", "s").alias("c"))
    lows = pairs.groupBy("c").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("c", "b")
    return cut(pairs.join(plain(lows, "c"), "c").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def _grouped(docs: DataFrame, id_col: str, text: str, size: int = SHINGLE, radius: int = RADIUS, tree_limit: int = TREE_LIMIT, similar: bool = False) -> DataFrame:
    """(id, key, fp, root, component_id) of every row; rows of one group share their root."""
    ids = cut(fingerprints(docs, id_col, text, size, similar))
    distinct = cut(ids.groupBy("fp").agg(F.min("id").alias("low")))
    edges = links(distinct.select("fp"), radius, tree_limit)
    linked = connected_components(edges.unionAll(_set_edges(ids, docs, text)) if similar else edges)
    rooted = linked.join(distinct, linked.node == distinct.fp).select("fp", "low", F.col("component").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rooted.join(plain(smallest, "root"), "root").select("fp", "root", "component_id")
    groups = distinct.join(plain(found, "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    return ids.join(plain(groups, "fp"), "fp").select("id", "key", "fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that the row's fingerprint reaches; with ``similar`` also over
    texts whose five-word shingles have a Jaccard similarity of 0.8."""
    return _grouped(docs, id_col, text, **options).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp):
    """16 lowercase hex digits of a long column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """One row of each group, with its columns: that of the smallest id (a null one last), then of the smallest text hash; of
    repeated rows any one. The texts do not move while the rows that leave have at most ``broadcast_bytes`` of names."""
    each = cut(_grouped(docs, id_col, text, **options).groupBy("root", "id", "key").agg(F.count("*").alias("n")))
    low = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("low"))
    stays = F.col("id").eqNullSafe(F.col("low.id")) & (F.col("key") == F.col("low.key"))
    told = written(each.join(plain(low, "root"), "root").select(F.col("id").alias("__gid"), F.col("key").alias("__gkey"), "n", stays.alias("__stays")).where("not __stays or n > 1"))
    rows, repeated = told.agg(F.count("*"), F.count_if("__stays")).first()
    leaving = F.broadcast(told) if rows * 64 <= broadcast_bytes else told.hint("shuffle_hash")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    packed = docs.select(row, F.col(f"`{id_col}`").alias("__id"), F.xxhash64(f"`{id_col}`", f"`{text}`").alias("__key"))
    met = (F.col("__key") == F.col("__gkey")) & F.col("__id").eqNullSafe(F.col("__gid"))
    out = packed.join(leaving, met, "left_anti").select("__row")
    if repeated:  # of the rows that stay and are repeated, one each
        same = packed.join(told.where("__stays"), met, "left_semi")
        out = out.unionAll(same.groupBy("__id", "__key").agg(F.first("__row").alias("__row")).select("__row"))
    return out.select("__row.*")
