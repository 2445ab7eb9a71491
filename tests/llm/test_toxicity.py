import math
import random
import re
from zlib import crc32

from territory.llm import toxicity as X

TERMS = ["idiot", "stupid", "worthless", "scum"]


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edits(r, w, n):
    for _ in range(n):
        i = r.randrange(len(w))
        w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcdeiot*1") + w[i:], w[:i] + r.choice("abcdeiot*1") + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]])
    return w


def test_automaton_on_trie_and_filter_match_brute_force():
    r = random.Random(4)
    lex = X.Lexicon(TERMS, ["morb"])
    fuzzy = [t for t in TERMS if len(t) >= X.FUZZY_LENGTH]
    for _ in range(4000):
        w = edits(r, r.choice(TERMS), r.choice([0, 1, 1, 2, 3]))
        best = min((distance(w, t), t) for t in fuzzy)
        want = (w, 1.0) if w in TERMS else (best[1], X.FUZZY) if best[0] <= 1 and len(w) >= X.FUZZY_LENGTH - 1 else None
        assert lex.hit(w) == want, w
        assert lex.trie.near(w) == ((best[1], best[0]) if best[0] <= 1 else None), w
    assert lex.hit("morbid") == ("morb", 1.0) and lex.hit("morb" + "x" * 100) == ("morb", 1.0) and lex.hit("clean") is None


def brute_evidence(t, terms, stems, exact):
    """The evidence of a text by the module's docstring, place by place."""
    low = t.lower()
    places = [(m.start(), m.end()) for m in re.finditer(r"\w+(?:[*@$!]\w+)*", low)]
    total, seen = 0.0, set()
    for lo, hi in places:
        w = low[lo:hi]
        near = [(distance(w, x), x) for x in terms if len(x) >= 5 and x not in exact and len(w) >= 4]
        stem = next((s for s in sorted(stems) if w.startswith(s)), None)
        if w in terms:
            term, weight = w, 1.0
        elif stem:
            term, weight = stem, 1.0
        elif near and min(near)[0] <= 1:
            term, weight = min(near)[1], 0.8
        else:
            continue
        left, right = low[max(0, lo - 80) : lo].split("\n")[-1], low[hi : hi + 80].split("\n")[0]
        quoted = any(left.count(q) % 2 and q in right for q in "\"'") or any(left.rfind(a) > left.rfind(b) and b in right for a, b in ("“”", "«»"))
        before, after = [x for x in re.findall(r"\w+(?:[*@$!]\w+)*", left)][-3:], re.findall(r"\w+(?:[*@$!]\w+)*", right)[:3]
        if quoted or X._REPORTS & set(before):
            weight *= 0.3
        elif X._SECOND & {*before, *after}:
            weight *= 1.2
        total, seen = total + weight, seen | {term}
    return (math.log1p(total), math.log1p(100 * total / len(places)), math.log1p(len(seen))) if seen else (0.0, 0.0, 0.0)


def test_evidence_matches_brute_force():
    r = random.Random(11)
    lex = X.Lexicon(TERMS, ["morb"], ["worthless"])
    parts = [*TERMS, "idoit", "stupidd", "worthles", "scums", "morbid", "you", "du", "said", "calls", "wort", "the", "of", "clean", "words", '"', "'", "“", "”", "«", "»", "\n", ",", "."]
    for _ in range(600):
        t = " ".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        got, want = X.evidence(t, lex), brute_evidence(t, TERMS, ["morb"], ["worthless"])
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True)), (t, got, want)


def test_context():
    w = lambda t: X.context_weight(t, t.index("idiot"), t.index("idiot") + 5)
    assert w("they wrote idiot on it") == w('the word "idiot" is old') == w("« un idiot » ici") == X.QUOTED
    assert w("you are an idiot now") == X.DIRECT and w("such an idiot there") == 1.0
    lex = X.Lexicon(TERMS, [])
    assert X.evidence('he said "idiot" there', lex)[0] < X.evidence("what idiot is there", lex)[0]
    assert X.evidence(None, lex) == X.evidence("", lex) == (0.0, 0.0, 0.0)


def corpus(n, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 200))]
        tox = r.random() < 0.25
        if tox:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(TERMS))
        out.append((i, " ".join(words), int(tox)))
    return out


def test_table(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([(i, t, "en", 5.0) for i, t, _ in rows] + [(9001, None, None, None), (9002, "", "x", 1.0), (None, "idiot scum stupid", None, None), (0, rows[0][1], "en", 5.0), (9003, "an idoit and a stupidd scum " * 400, "en", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y, "z") for i, _, y in rows] + [(None, 1, 1, "z"), (77777, 0, 1, "z"), (5, 0, None, "z")], "doc_id long, quality int, toxic int, text string")
    model = X.train(docs, labels)
    assert set(TERMS) <= set(model.lexicon.terms)
    got = X.score(docs, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 805
    by = {r.doc_id: r for r in got.collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i in truth if i in set(held)) and len(held) > 100
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert by[9001].score == by[9002].score < 0.5 and by[None].held_out is False and by[9003].predicted == 1
    assert all(0 <= r.score <= 1 for r in by.values())
    none = X.train(docs, labels.limit(0))
    assert {r.predicted for r in X.score(docs, none).collect()} == {0}
    assert X.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_never_read(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = [i for i, *_ in rows if crc32(str(i).encode()) % 5 == 0]
    one = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = X.train(docs, one), X.train(docs, two)
    assert a.weights == b.weights and a.lexicon.terms == b.lexicon.terms
