import base64
import hashlib
import itertools
import json
import math
import random
import re
import time
import uuid

import numpy as np

from territory.llm import pii as P
from territory.llm import secret_scan as S
from territory.llm.spans import apart

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def brute_pii(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return out


def brute_secrets(t):
    out = [(0, *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return out


def soup(r, n=60):
    parts = ["@", ".", "+", "-", " ", "  ", "(", ")", "a", "b.c", "_", "1", "23", "456", "255", "256", "0", "4111111111111111", "example.com", "x@y.z", "é", "\n", "token", "=", ":", '"', "'", "PassWord", "api_key", "apikey", "AKIA", "ABCDEF123456789012", "deadbeef", "0123456789abcdef", "ſecret", "toKen"]
    return "".join(r.choice(parts) for _ in range(n))


def test_base_spans_match_the_patterns():
    r = random.Random(2)
    texts = [soup(r, r.randint(0, 80)) for _ in range(1500)]
    for t in texts:
        assert sorted(P.base_spans(t)) == sorted(brute_pii(t)), t
        assert sorted(S.base_spans(t)) == sorted(brute_secrets(t)), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 100_000, "1 " * 150_000):
        P.base_spans(t)
        S.base_spans(t)


def test_viterbi_is_exact_and_the_field_learns():
    crf = P.trained()
    rng = np.random.default_rng(0)
    ems = [rng.normal(size=(n, len(P.LABELS))).astype(np.float32) * 3 for n in (1, 2, 3, 4, 4)]
    start = np.where([x[0] == "I" for x in P.LABELS], -1e4, 0)
    for em, got in zip(ems, crf.viterbi(ems), strict=True):
        best = max(itertools.product(range(len(P.LABELS)), repeat=len(em)), key=lambda y: start[y[0]] + sum(em[i, k] for i, k in enumerate(y)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(y))) if len(em) < 4 else None
        if best:
            assert tuple(got) == best
    right = wrong = total = 0
    for t, spans in P.labelled_table(300, seed=123):
        got, want = set(P.added_spans([t], crf)[0]), {s for s in spans if P._valid(s[0], t[s[1] : s[2]])}
        right, wrong, total = right + len(got & want), wrong + len(got - want), total + len(want)
    assert right >= 0.95 * total and wrong <= 0.03 * total


def test_expectations_match_every_labelling():
    rng = np.random.default_rng(3)
    k, lens = 3, (1, 2, 4)
    em, tr, mask = rng.normal(size=(3, 4, k)), rng.normal(size=(k, k)), np.zeros((3, 4), bool)
    want_p, want_e = np.zeros((3, 4, k)), np.zeros((k, k))
    for i, n in enumerate(lens):
        mask[i, :n] = True
        every = list(itertools.product(range(k), repeat=n))
        weight = np.array([math.exp(sum(em[i, t, y[t]] for t in range(n)) + sum(tr[a, b] for a, b in itertools.pairwise(y))) for y in every])
        for y, q in zip(every, weight / weight.sum(), strict=True):
            for t in range(n):
                want_p[i, t, y[t]] += q
            for a, b in itertools.pairwise(y):
                want_e[a, b] += q
    p, e = P.expectations(em, tr, mask)
    assert np.allclose(p, want_p) and np.allclose(e, want_e)


def test_pii_table(spark):
    texts = ["mail joe@example.com from 10.0.0.1, call (017) 555-7713 é", None, "", "Joe [at] mail [dot] com", "plain words only", "4111 1111 1111 1111"]
    rows = [(i if i != 2 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n_ip int, spans string")
    got = P.find(docs)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7
    assert (by[0].n_email, by[0].n_ip, by[0].n_phone) == (1, 1, 0)
    assert by[0].spans == "email:5:20,ip:26:34,phone:41:55" and by[0].n_spans == 3
    assert by[0].base_sha256 == hashlib.sha256(b"email:5:20,ip:26:34").hexdigest()
    assert by[1].spans == by[4].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].spans == "email:0:23" and by[5].n_card == 1
    assert P.find(docs.limit(0)).count() == 0


#: The generic base64 formats have neither prefix nor places; only their length and padding tell them from random runs.
GENERIC = ("base64_key", "base64_pair")


def test_automata_accept_their_formats_and_leave_other_runs():
    m = S.trained()
    table = S.labelled_table(40, seed=77)
    of = [w for k, w in table if k not in GENERIC]
    assert sum(m.score(w) >= S.THRESHOLD for w in of) >= 0.97 * len(of)
    generic = [w for k, w in table if k in GENERIC]
    assert sum(m.score(w) >= S.THRESHOLD for w in generic) >= 0.6 * len(generic)
    background = [w for _, w in S.background_table(60, seed=78)]
    bad = [w for w in background if m.score(w) >= S.THRESHOLD]
    assert len(bad) <= 0.01 * len(background), bad


def test_places_and_lengths_count():
    m, r = S.trained(), random.Random(6)
    mean = lambda ws: sum(map(m.score, ws)) / len(ws)

    def moved(u):
        out = list(u.replace("-", ""))
        for at in sorted(r.sample(range(1, 31), 4)):
            out.insert(at, "-")
        return "".join(out)

    real = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(60)]
    assert mean(real) - mean([moved(u) for u in real]) > 40
    token = lambda n: ["ghp_" + "".join(r.choice(ALNUM) for _ in range(n)) for _ in range(60)]
    assert min(mean(token(36)) - mean(token(n)) for n in (20, 30, 35, 37, 50, 90)) > 3
    assert mean(token(90)) < S.THRESHOLD < mean(token(36)) - 8


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(n):
    """Texts with credentials made from digests of a counter, apart from the training table's rule, in several settings."""
    out = []
    for i in range(n):
        raw = hashlib.sha512(f"planted {i}".encode()).digest()
        b64 = base64.b64encode(raw).decode()
        plain = b64.replace("+", "x").replace("/", "Y").replace("=", "")
        head = base64.urlsafe_b64encode(json.dumps({"alg": ["HS256", "RS256", "ES256"][i % 3], "typ": "JWT"}).encode()).decode().rstrip("=")
        body = base64.urlsafe_b64encode(json.dumps({"sub": str(i * 7919), "name": "user" * (i % 4 + 1), "iat": 1_500_000_000 + i}).encode()).decode().rstrip("=")
        sign = base64.urlsafe_b64encode(raw[:32]).decode().rstrip("=")
        w = [
            "ghp_" + plain[:36], "gho_" + plain[10:46], "glpat-" + plain[:20], f"xoxb-{int.from_bytes(raw[:5], 'big') % 10**12 + 10**11}-{int.from_bytes(raw[5:10], 'big') % 10**12 + 10**11}-{plain[:24]}", "sk_live_" + plain[:24], "sk_test_" + plain[3:27],
            "AIza" + plain[:35], "npm_" + plain[:36], f"{head}.{body}.{sign}", str(uuid.UUID(bytes=raw[:16])), "ASIA" + base64.b32encode(raw).decode()[:16], f"SG.{plain[:22]}.{plain[20:63]}",
        ][i % 12]
        around = ["The key is {} and it works.", "export KEY={}", "curl -H 'Authorization: Bearer {}' host", 'login("{}")', "see {}, or ask; then go on with the prose of this line", "{}"][i % 6]
        text = around.format(w)
        out.append((text, text.index(w), len(w)))
    return out


def test_recall_on_credentials_that_the_table_did_not_make():
    cases = planted(600)
    found = S.added_spans([t for t, *_ in cases], S.trained())
    hit = sum(any(a <= at and at + n <= b for _, a, b in S.base_spans(t)) or any(abs(a - at) <= 4 and b == at + n for _, a, b in f) for (t, at, n), f in zip(cases, found, strict=True))
    assert hit >= 0.9 * len(cases), hit / len(cases)


def test_merging_agrees_with_brute_force():
    r = random.Random(8)
    for trial in range(12):
        words = ["".join(r.choice("ab-") for _ in range(r.choice([3, 3, 4, 6]))) if trial % 3 else "ab" * r.randint(1, 9) + "-" * (trial % 2) for _ in range(200)]
        tree = S.Automaton.__new__(S.Automaton)
        infer, S.Automaton._infer = S.Automaton._infer, lambda self: setattr(self, "states", list(range(len(self.next))))
        try:
            tree.__init__(words)
        finally:
            S.Automaton._infer = infer
        # every pair of states of the tree, by the words that go on from them
        at = {0: list(words)}
        for s in range(len(tree.next)):
            for k, t in tree.next[s].items():
                at[t] = [w[1:] for w in at[s] if w and S.Automaton.kind(w[0]) == k]

        def agree(x, y):
            if min(len(x), len(y)) < S.SUPPORT:
                return True
            far = tree.bound * (len(x) ** -0.5 + len(y) ** -0.5)
            tests = [lambda w: not w, *(lambda w, c=c: w[:1] == c for c in "ab-"), lambda w: w[:1] in ("a", "b")]
            if any(abs(sum(map(f, x)) / len(x) - sum(map(f, y)) / len(y)) > far for f in tests):
                return False
            return all(agree([w[1:] for w in x if w[:1] in g and w], [w[1:] for w in y if w[:1] in g and w]) for g in (("a", "b"), ("-",)) if any(w[:1] in g and w for w in x) and any(w[:1] in g and w for w in y))

        for a, b in itertools.combinations(range(min(12, len(tree.next))), 2):
            assert tree.compatible(a, b) == agree(at[a], at[b]), (trial, a, b)
        # the merged counts are those of the samples run through the automaton
        m = S.Automaton(words)
        count, end = {s: {} for s in m.states}, dict.fromkeys(m.states, 0)
        for w in words:
            s = 0
            for ch in w:
                count[s][ch] = count[s].get(ch, 0) + 1
                s = m.next[s][m.kind(ch)]
            end[s] += 1
        assert all(dict(m.count[s]) == count[s] and m.end[s] == end[s] for s in m.states)
        total = sum(math.exp(go[0]) for go in m.logs[0][0].values()) + math.exp(m.logs[0][1])
        assert 0.8 < total < 1.2


def test_merging_keeps_the_language_of_a_loop():
    r = random.Random(1)
    a = S.Automaton(["a-" * (1 + int(r.expovariate(0.7))) for _ in range(400)])
    assert len(a.states) <= 5
    assert a.score("a-" * 7) > a.score("-a" * 7) + 20


def test_apart_matches_brute_force_and_is_linear():
    r = random.Random(7)
    for _ in range(300):
        span = lambda: (r.randrange(3), a := r.randrange(60), a + r.randint(1, 9))
        base, added = [span() for _ in range(r.randrange(8))], [span() for _ in range(r.randrange(8))]
        want = []
        for x in sorted(added, key=lambda s: (s[1], s[0])):
            if all(x[2] <= a or b <= x[1] for _, a, b in base) and (not want or want[-1][2] <= x[1]):
                want.append(x)
        assert apart(added, base) == want
    many = [(0, 10 * i, 10 * i + 4) for i in range(100_000)]
    began = time.process_time()
    assert len(apart([(1, a + 5, b + 5) for _, a, b in many], many)) == 100_000
    assert time.process_time() - began < 5


def test_secret_table(spark):
    texts = ['token = "0123456789abcdef0123"', None, "", "see ghp_Ab3dEf6hIj9lMnOpQrStUvWxYz0123456789 end.", "clean words-and-things here", "x" * 100_000]
    rows = [(i if i != 2 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, spans string")
    got = S.find(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7
    assert by[0].spans == "assign:0:29,hex:9:29" and (by[0].n_assign, by[0].n_hex) == (1, 1)
    assert by[3].spans == "format:4:44"
    assert by[1].spans == by[4].spans == by[5].spans == ""
    assert S.find(docs.limit(0)).count() == 0
