import os
import random
import subprocess
import sys

import numpy as np
import pytest

from territory.llm import piece_codec as C

pytestmark = pytest.mark.skipif(not os.path.exists(C.MODEL_PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def pieces():
    return C.Pieces.load()


def small():
    """A vocabulary of few pieces with many ways to cut a text."""
    plain = [" ", "a", "b", "ab", " a", "ba", "aba", "  ", " ab", ".", "..", "é", "bb", " b", "_", "_."]
    return C.Pieces.ranked([(p, 300 + i) for i, p in enumerate(plain)], list(range(256)))


def every_path(p, s):
    """(score, ids) of every segmentation of s, which has the leading space."""
    if not s:
        return [(0.0, [])]
    out = []
    hits = [(n, *p.piece[s[:n]]) for n in range(1, min(len(s), p.longest) + 1) if s[:n] in p.piece]
    for n, i, sc in hits:
        out += [(sc + a, [i, *b]) for a, b in every_path(p, s[n:])]
    if not any(n == 1 for n, *_ in hits):
        b = [p.byte[x] for x in s[0].encode()]
        out += [(C.BYTE_SCORE * len(b) + a, [*b, *c]) for a, c in every_path(p, s[1:])]
    return out


def ids_of(ids):
    return ids.tolist()


def test_n_best_matches_every_path():
    p, r = small(), random.Random(1)
    for _ in range(250):
        t = "".join(r.choice("aab  b.\n_zé") for _ in range(r.randint(1, 9)))
        want = sorted((s for s, _ in every_path(p, " " + t)), reverse=True)[:4]
        raw, score, others = p.encode(t, 4)
        best = ids_of(raw)
        got = [(score, best)] + [(s, C.apply_edits(best, e)) for s, e in others]
        assert len(got) == len(want) and np.allclose([s for s, _ in got], want, atol=1e-6), t
        assert len({tuple(i) for _, i in got}) == len(got)
        assert all(p.decode(i) == t for _, i in got)
        paths = {tuple(i): s for s, i in every_path(p, " " + t)}
        assert all(abs(paths[tuple(i)] - s) < 1e-6 for s, i in got)


def test_search_backward_yields_paths_in_order():
    p = small()
    got = p.n_best(" abaabab", 30)
    want = sorted((s for s, _ in every_path(p, " abaabab")), reverse=True)[:30]
    assert np.allclose([s for s, _ in got], want) and len({tuple(i) for _, i in got}) == len(got)


def test_numpy_units_match_one_by_one(pieces):
    r = random.Random(2)
    alphabet = "abcdeinorst éßñ.,'-_0123😀中️ "
    units = {u for _ in range(800) for u in pieces.units("".join(r.choice(alphabet) for _ in range(r.randint(1, 40))))}
    many = pieces.solve_many(sorted(units))
    assert set(many) == units
    for u in units:
        one = pieces.solve(u)
        assert many[u][0] == one.ids and abs(many[u][1] - one.score) < 1e-9
        assert many[u][2] == one.loss or abs(many[u][2] - one.loss) < 1e-9


def texts():
    r = random.Random(3)
    anything = ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x2000, 0xD7FF), r.randint(0xE000, 0x1F9FF)])) for _ in range(60)) for _ in range(30)]
    return ["Hello world", " a  b\n\nc\t d", "  ", "\n", "é 😀 \x01", "▁x ▁", "a\xa0b", "ﬁ Å", "\r\n", "x" * 60_000, " " * 5_000, "word " * 20_000, "中文字" * 3000, "_._. ²..", *anything]


def test_round_trips_and_the_library_reads_the_ids(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL_PATH)
    for t in texts():
        raw, _, others = pieces.encode(t)
        ids = ids_of(raw)
        assert pieces.decode(ids) == t
        if "▁" not in t:
            assert sp.decode(ids) == t
        assert all(pieces.decode(C.apply_edits(ids, e)) == t for _, e in others)


def plainly(found):
    return [(ids.tolist(), score, others) for ids, score, others in found]


def test_forgetting_and_parts_change_nothing(pieces, monkeypatch):
    ts = texts()[:14]
    want = plainly(pieces.encode(t) for t in ts)
    assert plainly(pieces.encode_all(ts)) == want
    monkeypatch.setattr(C, "REMEMBERED", 500)
    assert plainly(pieces.encode(t) for t in ts * 2) == want * 2
    monkeypatch.setattr(C, "TOGETHER", 1000)
    for (ids, score, others), (ids2, score2, others2) in zip(plainly(pieces.encode(t) for t in ts), want, strict=True):
        assert ids == ids2 and abs(score - score2) < 1e-6 * max(1, abs(score)) and [e for _, e in others] == [e for _, e in others2]


_MEASURE = """
import random, sys
from territory.llm import piece_codec as C
import pyarrow as pa
now = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) / 1024
r, p = random.Random(1), C.Pieces.load()
base, most = now(), 0
for _ in range(12):  # ever new words
    texts = pa.array([" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)) for _ in range(700)])
    for t in C._together(texts):
        p.encode_all(t)
        most = max(most, now())
print(most - base, p.held)
"""


def test_a_workers_memory_is_bounded():
    """Peak private memory over 12 batches of words that do not repeat."""
    run = subprocess.run([sys.executable, "-c", _MEASURE], capture_output=True, text=True, check=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    grown, held = map(float, run.stdout.split())
    assert grown < 220 and held < C.REMEMBERED + C.TOGETHER * C.OVERHEAD / 4


def test_tables(spark, pieces):
    clash = spark.createDataFrame([(1, "Hello", 2.0, 3)], "doc_id long, text string, score double, n_pieces int")
    assert [r.n_pieces > 0 for r in C.encode(clash, pieces).collect()] == [True]
    rows = [(1, "Hello world, hello lattice", "x"), (2, None, None), (None, "", "y"), (1, "Hello world, hello lattice", "x"), (5, "▁ literal\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = C.encode(df, pieces)
    out = got.collect()
    assert got.columns == ["doc_id", "n_pieces", "score", "ids", "nbest", "round_trip"] and len(out) == 5
    by = {r.doc_id: r for r in out}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out)
    assert by[2].ids == [] and by[2].nbest == [] and len(by[1].nbest) == 2
    assert by[1].nbest[0].score >= by[1].nbest[1].score and by[1].score >= by[1].nbest[0].score
    back = {r.doc_id: r.back for r in C.decode(got, pieces, text="back").collect()}
    assert back[1] == rows[0][1] and back[2] == "" and back[5] == "▁ literal\n"
    assert C.encode(df.limit(0), pieces).count() == 0
