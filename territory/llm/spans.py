"""Spans of kinds in a text: what the PII and secret operators share.

A span is (kind index, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, int]


def joined(spans: list[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))


def apart(added: list[Span], base: list[Span]) -> list[Span]:
    """The added spans that overlap neither a base span nor an earlier added one; one pass over both in order of start."""
    taken, out, at = sorted((a, b) for _, a, b in base), [], 0
    reach = -1  # the furthest end of the base spans that begin before the added one's end
    for s in sorted(added, key=lambda s: (s[1], s[0])):
        while at < len(taken) and taken[at][0] < s[1]:
            reach, at = max(reach, taken[at][1]), at + 1
        ahead = at < len(taken) and taken[at][0] < s[2]
        if reach <= s[1] and not ahead and (not out or out[-1][2] <= s[1]):
            out.append(s)
    return out


def find_spans(docs: DataFrame, kinds: Sequence[str], base: Callable[[str], list[Span]], method: Callable[[list[str]], list[list[Span]]], id_col: str, text: str) -> DataFrame:
    """(id, n_<kind> of the base spans, base_sha256, spans, n_spans of all): one row for every row of docs.

    ``base`` gives a text's base spans, ``method`` the added ones of a list of texts. A null text is empty.
    """
    names = [f"n_{k}" for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            own = [base(t) for t in texts]
            more = [apart(m, o) if m else [] for m, o in zip(method(texts), own, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in o) for o in own], pa.int64()) for k in range(len(kinds))]
            told = [joined(o, kinds) for o in own]
            sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in told], pa.string())
            full = pa.array([joined([*o, *m], kinds) if m else t for o, m, t in zip(own, more, told, strict=True)], pa.string())
            every = pa.array([len(o) + len(m) for o, m in zip(own, more, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, full, every], [id_col, *names, "base_sha256", "spans", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{n}` long" for n in names) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
