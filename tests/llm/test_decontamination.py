import datetime
import decimal
import random
import time

import numpy as np

from territory.llm import decontamination as D


def words(r, n):
    return " ".join("".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 9))) for _ in range(n))


def edited(r, t, n):
    for _ in range(n):
        i = r.randrange(len(t))
        t = r.choice([t[:i] + t[i + 1 :], t[:i] + r.choice("abcxyz") + t[i:], t[:i] + r.choice("abcxyz") + t[i + 1 :]])
    return t


def full_cost(pattern, text):
    """Least edits of the pattern anywhere in the text: every cell."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != ch), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_grams_are_hashes_of_ten_characters():
    r = random.Random(1)
    t = words(r, 60) + "é€😀" + words(r, 5)
    g = D.grams(t)
    assert len(g) == len(t) - 9
    by = {}
    for i, h in enumerate(g.tolist()):
        assert by.setdefault(t[i : i + 10], h) == h
    assert len(set(by.values())) == len(by)
    assert len(D.grams("a" * 9)) == 0 and D.grams(t[5:15])[0] == g[5]


def test_alignment_matches_the_full_table():
    r = random.Random(2)
    for _ in range(150):
        p = words(r, 12)[: r.randint(24, 60)]
        k = r.randint(0, 6)
        t = words(r, 5) + " " + edited(r, p, r.randint(0, 8)) + " " + words(r, 5)
        want, got = full_cost(p, t), D.align(p, t, k)
        assert (got[0] if got else None) == (want if want <= k else None)
        if got and got[0]:
            assert full_cost(p, t[got[1] : got[2]]) == got[0]


def test_least_edits_match_the_full_table():
    r = random.Random(12)
    pairs = []
    for _ in range(400):
        p = words(r, 30)[: r.choice([13, 15, 63, 64, 65, 100, 127, 128])] + "é" * (_ % 2)
        pairs.append((p[:128], words(r, 4) + edited(r, p, r.randint(0, 12))[r.randint(0, 3) :] + words(r, r.randint(0, 6))))
    assert D.least_edits(pairs).tolist() == [full_cost(p, t) for p, t in pairs]
    assert D.least_edits([]).tolist() == []


def test_phrases_of_many_items_repeated_take_little_time():
    r = random.Random(13)
    stock = words(r, 14)[:80]
    items = [(i, words(r, 3)[:12] + " " + stock + " " + words(r, 30)) for i in range(400)]
    index = D.Index(items)
    t = " ".join(f"{stock} {words(r, 2)}" for _ in range(150))
    began = time.process_time()
    assert D.find_all([t], index) == [[]]
    assert time.process_time() - began < 8  # 2 s on a free core
    few = D.Index(items[:6])
    for t in (f"{words(r, 3)} {items[2][1][:110]}", " ".join(f"{stock} {words(r, 2)}" for _ in range(3))):
        want = {few.item[s] for s, p in enumerate(few.text) if full_cost(p, D.normal(t)) <= few.k[s]}
        assert {i for i, *_ in D.find_all([t], few)[0]} == want


def test_parts_of_postings_change_nothing(monkeypatch):
    r = random.Random(14)
    items = [(i, words(r, 40)) for i in range(8)]
    index = D.Index(items)
    texts = [" ".join(edited(r, r.choice(items)[1][50:250], 3) + words(r, 5) for _ in range(6)) for _ in range(5)]
    want = D.find_all(texts, index)
    assert all(want)
    monkeypatch.setattr(D, "POSTINGS", 7)
    assert D.find_all(texts, index) == want


def test_short_items_match_whole_words_and_ids_are_of_any_type(spark):
    index = D.Index([(1, "Red fox?"), (2, "fox"), (None, "the end")])
    assert D.find_all(["A red, FOX ran", "red foxes", "fox", "red fox red fox", None, "x the end"], index) == [[(1, 2, 10)], [], [], [(1, 0, 7), (1, 8, 15)], [], [(None, 2, 9)]]
    docs = spark.createDataFrame([("a", "one red fox"), ("b", "none")], "doc_id string, text string")
    for kind, value in (("decimal(5,1)", decimal.Decimal("7.5")), ("string", "q"), ("smallint", 3), ("date", datetime.date(2020, 1, 2))):
        items = spark.createDataFrame([(value, "red fox")], f"item_id {kind}, text string")
        assert {r.doc_id: [m.item for m in r.matches] for r in D.contamination(docs, items).collect()} == {"a": [value], "b": []}


def test_filter_loses_nothing_and_finds_nothing_else():
    r = random.Random(3)
    items = [(i, words(r, r.choice([5, 12, 20, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "short"), (3, "x")]
    index = D.Index(items)
    texts = []
    for _ in range(40):
        seg = r.choice(index.text)
        texts.append(words(r, r.randint(0, 30)) + " " + edited(r, seg, r.randint(0, 12)) + " " + words(r, r.randint(0, 30)))
    texts += [words(r, 60), "on on on " * 300, ""]
    got = D.find_all(texts, index)
    for t, f in zip(texts, got, strict=True):
        n = D.normal(t)
        want = {index.item[s] for s, p in enumerate(index.text) if full_cost(p, n) <= index.k[s]}
        assert {i for i, *_ in f} == want


def test_original_places_and_chunks():
    r = random.Random(4)
    item = words(r, 30)
    index = D.Index([(7, item)])
    shout = " ** ".join(w.upper() for w in item.split())
    texts = ["İ, lead-in. " + shout + "!! tail", words(r, 20), "é " * 200_000 + item, item]
    got = D.find_all(texts, index)
    assert not got[1] and all(got[i] for i in (0, 2, 3))
    a, e = got[0][0][1], got[0][-1][2]
    assert texts[0][a:e] == shout
    assert texts[2][got[2][0][1] : got[2][-1][2]] == item
    assert [bool(x) for x in D.find_all(texts * 3, index)] == [True, False, True, True] * 3


def test_tables(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, words(r, 30)) for i in range(6)]
    bench = spark.createDataFrame([*items, (9, None), (None, "tiny"), items[0]], "item_id long, text string")
    rows = [(1, words(r, 10) + " " + items[2][1], "m"), (2, words(r, 50), "m"), (3, None, None), (4, "", "m"), (None, items[4][1], "m"), (1, items[0][1], "again"), (2, words(r, 4), "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    want = sorted(map(str, [(1, [2]), (2, []), (3, []), (4, []), (None, [4]), (1, [0]), (2, [])]))
    got = D.contamination(docs, bench)
    assert sorted(str((x.doc_id, sorted({m.item for m in x.matches}))) for x in got.collect()) == want
    assert sorted(map(str, D.clean(docs, bench).collect())) == sorted(map(str, docs.collect()[1:4] + docs.collect()[6:]))
    assert D.contamination(docs, bench.limit(0)).where("size(matches) > 0").count() == 0
    assert D.contamination(docs.limit(0), bench).count() == 0
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert sorted(str((x.doc_id, sorted({m.item for m in x.matches}))) for x in D.contamination(docs, bench).collect()) == want
    assert sorted(map(str, D.clean(docs, bench).collect())) == sorted(map(str, docs.collect()[1:4] + docs.collect()[6:]))
    assert np.array_equal(D.grams("abcdefghijk")[:1], D.grams("abcdefghij"))
