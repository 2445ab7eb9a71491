"""Op 5. PII: base patterns, and a linear-chain conditional random field over word-shape features.

The field is trained at start from a small labelled table of token sequences (``labelled_table``: made by rule from a
fixed seed, ``TRAIN_ROWS`` rows long, with look-alikes such as years, prices, versions and failing card numbers labelled
as nothing), by full-batch gradient ascent with forward-backward in numpy. Its few thousand weights go to the workers
with the function. Sequences to decode are the windows of ``CONTEXT`` characters around digits, ``@`` and spelt-out at and
dot signs, over the whole of every text; windows that meet are one sequence, however long. Viterbi decodes a batch's
windows together, those of like length side by side. Decoded spans are added where they have their kind's form and meet no
base span: phone numbers without ``+``, card numbers with other separators, spelt-out email addresses, addresses of hosts
with bracketed or spaced dots. Base spans always stay.

Defined results: null text is empty and has no spans; ids may be null; repeated rows are judged one by one; other columns
are not read; an empty table gives an empty table. The n_ columns and base_sha256 tell of the base spans alone.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from territory.llm.spans import Span, find_spans

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, TRAIN_STEPS, L2 = 2000, 90, 1e-4
#: Characters of context around what makes a window, and most sequences x steps that are decoded at once.
CONTEXT, BATCH_CELLS = 32, 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str) -> list[Span]:
    """Leftmost matches: a run of local characters right before an @, then a domain with a dot."""
    out, low, at = [], 0, t.find("@")
    while at >= 0:
        run = t[low:at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        m = _DOMAIN.match(t, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            out.append((0, start, low))
        at = t.find("@", low)
    return out


def base_spans(t: str) -> list[Span]:
    out = _emails(t) if "@" in t else []
    if not _DIGIT.search(t):
        return out
    if t.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in t:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# The field: tokens, features, training, decoding

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_MAKES_WINDOW = re.compile(r"[0-9@]+|[(\[<{] ?(?:at|AT|dot|DOT) ?[)\]>}]|\b(?:dot|DOT)\b")
_GROUP = re.compile(r"[0-9](?:[0-9 .\-()/_\[\]]*[0-9])?")
_DIGITS = re.compile(r"[0-9]+")
_CUES = {"tel", "phone", "call", "fax", "mobile", "card", "visa", "pay", "ip", "host", "mail", "email", "contact", "at", "dot", "com", "org", "net", "example", "version", "isbn", "order", "page", "year"}
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))


def _shape(tok: str) -> str:
    if tok.isdigit():
        return f"d{min(len(tok), 9)}"
    if tok.isalpha():
        return ("X" if tok[0].isupper() else "x") + ("X" if tok[1:2].isupper() else "x" if len(tok) > 1 else "")
    return tok


def tokens(t: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(t, lo, hi)]


def features(t: str, toks: list[tuple[str, int, int]]) -> list[list[str]]:
    """The feature names of each token: its own and its neighbours' shapes, cue words, gaps, and what its group of digits is like."""
    if not toks:
        return []
    shapes = ["<s>", "<s>", *(_shape(x[0]) for x in toks), "</s>", "</s>"]
    lows = [x[0].lower() if x[0].isalpha() else "" for x in toks]
    cues = ["", "", *(w if w in _CUES else "" for w in lows), "", ""]
    groups, at = [], 0
    for m in _GROUP.finditer(t, toks[0][1], toks[-1][2]):
        d = _NOT_DIGIT.sub("", m[0])
        kind = "card" if 12 <= len(d) <= 19 and luhn(d) else "long" if len(d) >= 12 else "mid" if len(d) >= 9 else "seven" if len(d) >= 7 else "few"
        parts = [min(len(x), 9) for x in _DIGITS.findall(m[0])]
        form = "-".join(map(str, parts)) if len(parts) < 7 else "many"
        between = "".join(sorted({c for c in m[0] if not c.isdigit()}))
        groups.append((m.start(), m.end(), f"{kind}.{min(m[0].count('.'), 4)}.{m[0].count('-') > 0}.{m[0].count(')') > 0}", f"{form} {between}", m[0][:2] == "00" or m[0][0] == "0" and len(parts) > 1))
    out = []
    for i, (w, a, b) in enumerate(toks):
        j = i + 2
        gap, after = (i == 0 or toks[i - 1][2] < a), (i + 1 == len(toks) or toks[i + 1][1] > b)
        while at < len(groups) and groups[at][1] <= a:
            at += 1
        inside = at < len(groups) and groups[at][0] <= a
        g = groups[at][2] if inside else "none"
        f = ["1", f"s0={shapes[j]}", f"s-1={shapes[j - 1]}", f"s+1={shapes[j + 1]}", f"s-2={shapes[j - 2]}", f"s+2={shapes[j + 2]}", f"s-10={shapes[j - 1]} {shapes[j]}", f"s01={shapes[j]} {shapes[j + 1]}", f"g={g}", f"gs={g} {shapes[j]}", f"gap={gap}{after} {shapes[j]}"]
        f += [f"c{k}={cues[j + k]}" for k in (-2, -1, 0, 1, 2) if cues[j + k]]
        if inside:
            f += [f"p={groups[at][3]}", f"p0={groups[at][3]} {a == groups[at][0]}", f"z={groups[at][4]}.{len(groups[at][3])}"]
        if w.isdigit() and int(w[:4]) > 255:
            f.append("over255")
        out.append(f)
    return out


#: Ends of the addresses made.
TOPS = ("com", "org", "net", "de", "fr", "es", "io", "info", "co.uk", "com.br")


def labelled_table(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """(text, its spans), made by rule: filler words, one or two entities or look-alikes, and sometimes a cue word."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda a=2, b=9: "".join(r.choice("aeinrstlhdou") for _ in range(r.randint(a, b)))

    def card(ok: bool) -> str:
        while True:
            d = r.choice("3456") + num(r.choice([14, 15, 15, 15]))
            if luhn(d) == ok:
                return d

    def split4(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def name() -> str:
        return r.choice([word(), word(), word(1, 1)]) + r.choice(["", "", "_" + word(), "-" + word(), "." + word(), "." + word(), num(2)])

    def host() -> str:
        return r.choice([word(), word(), f"{word()}-{word()}", word() + num(1)])

    def email() -> str:
        return f"{name()}@{host()}.{r.choice(TOPS)}"

    def spelt() -> str:
        top = r.choice(TOPS).split(".")
        style = r.randrange(4)
        if style < 2:
            o, c = r.choice(["()", "[]", "<>", "{}"])
            upper, gap = r.random() < 0.25, r.choice(["", " ", " "])
            at, dot = ("AT", "DOT") if upper else ("at", "dot")
            at, dot = f"{gap}{o}{at}{c}{gap}", f"{gap}{o}{dot}{c}{gap}" if r.random() < 0.8 else "."
        else:
            at, dot = (" at ", " dot ") if style == 2 else (" AT ", " DOT ")
        return name() + at + dot.join([*([word()] if r.random() < 0.2 else []), host(), *top])

    def separated(parts: list[str], seps: list[str]) -> str:
        return r.choice(seps).join(parts)

    def amex() -> str:
        while not luhn(d := "3" + r.choice("47") + num(13)):
            pass
        return separated([d[:4], d[4:10], d[10:]], [" ", "-", ".", "/", " - "])

    def phone() -> str:
        a, b = r.choice(["", "0"]), r.choice(["49", "33", "34", "44", "39", "1"])
        return r.choice(
            [
                f"+{b} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}", separated([num(3), num(3), num(4)], ["-", ".", " ", "/"]), f"+{b} {num(3)} {num(3)} {num(4)}",
                f"0{num(2)} {num(3)} {num(2)} {num(2)}", f"0{num(r.randint(2, 4))}{r.choice(['/', '-', ' ', ' / '])}{num(r.randint(6, 8))}", f"00{b} {num(r.randint(2, 3))} {num(r.randint(5, 7))}", separated([f"00{b}", num(3), num(3), num(r.randint(2, 4))], [" ", "-", "."]),
                separated([f"0{num(1)}", num(2), num(2), num(2), num(2)], [" ", ".", "-"]), f"1{r.choice('-. ')}{num(3)}{r.choice('-. ')}{num(3)}{r.choice('-. ')}{num(4)}",
            ]
        )

    def spaced_ip() -> str:
        return separated(ip().split("."), ["[.]", "(.)", " . ", "[.]", " [.] ", "[dot]"])

    entity = [lambda: (0, email()), lambda: (0, spelt()), lambda: (0, spelt()), lambda: (1, ip()), lambda: (1, spaced_ip()), lambda: (2, card(True)), lambda: (2, split4(card(True), r.choice([" ", "-", ".", "/", "_", "  ", " - "]))), lambda: (2, amex()), lambda: (3, phone()), lambda: (3, phone())]
    other = [
        lambda: str(r.randint(1900, 2050)), lambda: num(r.randint(1, 6)), lambda: f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{num(2)},{num(3)}.{num(2)}", lambda: card(False), lambda: split4(card(False), r.choice([" ", "-", ".", "/", "  "])),
        lambda: f"{r.randint(1, 28)}-{r.randint(1, 12)}-{r.randint(1990, 2030)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(0, 23)}:{num(2)}:{num(2)}", lambda: f"{r.randint(0, 23)}:{num(2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"@{word()}", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"{num(9)}{num(9)}{num(4)}", lambda: word() + num(3), lambda: f"§{num(3)}",
        lambda: f"{num(4)}/{num(2)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{r.randint(1, 9)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"{r.randint(1, 9)},{num(3)},{num(3)},{num(3)}", lambda: f"{num(1)} {num(3)} {num(3)}", lambda: " ".join(num(4) for _ in range(r.randint(2, 3))), lambda: " ".join(num(r.randint(1, 3)) for _ in range(r.randint(2, 6))),
        lambda: f"{word()} at {word()} {word()}", lambda: f"at the dot {word()}", lambda: f"{word()} dot {word()}", lambda: f"at {num(1)} dot {num(2)}", lambda: f"{word()} at {num(2)}", lambda: f"look at {word()} . {word()}", lambda: f"({num(3)}) {num(3)}", lambda: f"{num(2)} . {num(2)}",
        lambda: f"{num(5)}-{num(4)}", lambda: f"{num(2)}-{num(2)}-{num(2)}", lambda: f"{r.randint(1, 9)}. {word()}", lambda: f"{num(10)}", lambda: f"{num(11)}", lambda: f"({r.randint(1900, 2030)}) {num(1)}:{num(2)}", lambda: f"{word()}.{word()}/{num(3)}-{num(3)}",
    ]
    out = []
    for _ in range(rows):
        text, spans = " ".join(word() for _ in range(r.randint(0, 5))), []
        for _ in range(r.choice([1, 1, 2, 3])):
            if r.random() < 0.3:
                text += " " + r.choice(["tel", "card", "ip", "mail", "version", "order", "isbn", "call", "year"]) + r.choice(["", ":"])
            text += r.choice([" ", " ", " ", ' "', " ("]) if text else ""
            if r.random() < 0.5:
                k, e = r.choice(entity)()
                spans.append((k, len(text), len(text) + len(e)))
            else:
                e = r.choice(other)()
            text += e + r.choice(["", "", ",", ".", "%%%"]) + "".join(" " + word() for _ in range(r.randint(0, 4)))
        out.append((text, spans))
    return out


def _tag(toks, spans) -> list[int]:
    y = [0] * len(toks)
    for k, a, b in spans:
        inside = [i for i, (_, s, e) in enumerate(toks) if a <= s and e <= b]
        for n, i in enumerate(inside):
            y[i] = 1 + 2 * k + (n > 0)
    return y


def expectations(em: np.ndarray, tr: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Under the field's distribution the probability of each label at each step of each sequence, and how often each label
    is expected to follow each other one in all; forward and backward, scaled to a sum of 1 at each step. ``mask`` tells
    which steps a sequence has, from the first on."""
    n, size, k = em.shape
    x, e = np.exp(em - em.max(axis=2, keepdims=True)), np.exp(tr)
    al, be, c = np.zeros_like(x), np.ones_like(x), np.ones((n, size, 1))
    for t in range(size):
        step = (al[:, t - 1] @ e) * x[:, t] if t else x[:, 0]
        live = mask[:, t, None]
        c[:, t] = np.where(live, step.sum(axis=1, keepdims=True), 1)
        al[:, t] = np.where(live, step / c[:, t], al[:, t - 1])
    for t in range(size - 2, -1, -1):
        step = (x[:, t + 1] * be[:, t + 1]) @ e.T / c[:, t + 1]
        be[:, t] = np.where(mask[:, t + 1, None], step, 1)
    after = (x * be / c)[:, 1:] * mask[:, 1:, None]
    return al * be * mask[..., None], e * (al[:, :-1].reshape(-1, k).T @ after.reshape(-1, k))


class CRF:
    """``names``: feature -> row of ``w``; ``trans``: label to label."""

    def __init__(self, names: dict[str, int], w: np.ndarray, trans: np.ndarray) -> None:
        self.names, self.w, self.trans = names, w, trans

    @classmethod
    def train(cls, table: list[tuple[str, list[Span]]], steps: int = TRAIN_STEPS, rate: float = 0.25) -> CRF:
        toks = [tokens(t, 0, len(t)) for t, _ in table]
        feats = [features(t, k) for (t, _), k in zip(table, toks, strict=True)]
        names: dict[str, int] = {}
        for s in feats:
            for f in s:
                for x in f:
                    names.setdefault(x, len(names))
        n, size, k = len(table), max(map(len, toks)), len(LABELS)
        y, mask = np.zeros((n, size), int), np.zeros((n, size), bool)
        where, what = [], []
        for i, (s, tk) in enumerate(zip(feats, toks, strict=True)):
            y[i, : len(tk)], mask[i, : len(tk)] = _tag(tk, table[i][1]), True
            for j, f in enumerate(s):
                where += [i * size + j] * len(f)
                what += [names[x] for x in f]
        where, what, eye = np.array(where), np.array(what), np.eye(k)
        w, tr = np.zeros((len(names), k)), np.zeros((k, k))
        mw, mt = np.zeros_like(w), np.zeros_like(tr)
        gold = (eye[y] * mask[..., None]).reshape(-1, k)
        pairs = mask[:, 1:]
        gold_t = np.zeros((k, k))
        np.add.at(gold_t, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        for _ in range(steps):
            em = np.zeros((n * size, k))
            np.add.at(em, where, w[what])
            p, edge = expectations(em.reshape(n, size, k), tr, mask)
            gw = np.zeros_like(w)
            np.add.at(gw, what, (gold - p.reshape(-1, k))[where])
            gw, gt = gw / n - L2 * w, (gold_t - edge) / n - L2 * tr
            mw, mt = mw + gw**2, mt + gt**2
            w, tr = w + rate * gw / np.sqrt(mw + 1e-8), tr + rate * gt / np.sqrt(mt + 1e-8)
        for a in range(k):  # an inside label follows its own kind alone
            for b in range(1, k):
                if LABELS[b][0] == "I" and (a == 0 or LABELS[a][2:] != LABELS[b][2:]):
                    tr[a, b] = -1e4
        return cls(names, w.astype(np.float32), tr.astype(np.float32))

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        get, out = self.names.get, np.zeros((len(feats), len(LABELS)), np.float32)
        for i, f in enumerate(feats):
            out[i] = self.w[[x for x in map(get, f) if x is not None]].sum(axis=0)
        return out

    def viterbi(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence; sequences of like length go side by side."""
        out: list = [None] * len(ems)
        order = sorted(range(len(ems)), key=lambda i: len(ems[i]))
        while order:
            take, cells = [], 0
            while order and (not take or cells + len(ems[order[-1]]) <= BATCH_CELLS and len(take) < 4096):
                take.append(order.pop())
                cells = len(take) * len(ems[take[0]])
            n, size, k = len(take), len(ems[take[0]]), len(LABELS)
            em, lens = np.zeros((n, size, k), np.float32), np.array([len(ems[i]) for i in take])
            for j, i in enumerate(take):
                em[j, : lens[j]] = ems[i]
            back = np.zeros((n, size, k), np.int8)
            s = em[:, 0] + np.where([x[0] == "I" for x in LABELS], -1e4, 0)
            for t in range(1, size):
                every = s[:, :, None] + self.trans
                best = every.argmax(axis=1)
                go = np.take_along_axis(every, best[:, None], 1)[:, 0] + em[:, t]
                live = (t < lens)[:, None]
                back[:, t] = np.where(live, best, np.arange(k))
                s = np.where(live, go, s)
            path = np.zeros((n, size), np.int8)
            path[:, -1] = s.argmax(axis=1)
            for t in range(size - 1, 0, -1):
                path[:, t - 1] = back[np.arange(n), t, path[:, t]]
            for j, i in enumerate(take):
                out[i] = path[j, : lens[j]]
        return out


@lru_cache(maxsize=1)
def trained() -> CRF:
    return CRF.train(labelled_table())


def windows(t: str) -> list[tuple[int, int]]:
    """Stretches of the text to decode, grown to whole tokens; those that meet are one."""
    out: list[list[int]] = []
    for m in _MAKES_WINDOW.finditer(t):
        lo, hi = max(0, m.start() - CONTEXT), min(len(t), m.end() + CONTEXT)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    for w in out:
        while w[0] > 0 and t[w[0] - 1].isalnum() and t[w[0]].isalnum():
            w[0] += 1  # a word that is cut is left out
            if w[0] >= w[1]:
                break
        while w[1] < len(t) and w[1] > w[0] and t[w[1]].isalnum() and t[w[1] - 1].isalnum():
            w[1] -= 1
    return [(a, b) for a, b in out if a < b]


_SIGN_AT, _SIGN_DOT = r"\s*[(\[<{]\s?(?:at|@)\s?[)\]>}]\s*", r"\s*(?:[(\[<{]\s?(?:dot|\.)\s?[)\]>}]|\.)\s*"
_NAME, _PART = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_FORMS = (
    re.compile(rf"{_NAME}{_SIGN_AT}{_PART}(?:{_SIGN_DOT}{_PART})*{_SIGN_DOT}[A-Za-z]{{2,10}}|{_NAME}\s+at\s+{_PART}(?:\s+dot\s+{_PART})*\s+dot\s+[A-Za-z]{{2,10}}", re.I),
    re.compile(r"[0-9]{1,3}(?:\s*(?:[(\[{]\s?(?:\.|dot)\s?[)\]}]|\.)\s*[0-9]{1,3}){3}", re.I),
    re.compile(r"[0-9]+(?: ?[\x20.\-/_] ?[0-9]+)*"),
    re.compile(r"[+(]?[0-9](?:[0-9 ().\-]|(?<! )/|/(?! ))*[0-9]|[0-9]+ / [0-9]+"),
)


def _valid(kind: int, s: str) -> bool:
    """Has the string the form of its kind?"""
    if not _FORMS[kind].fullmatch(s):
        return False
    d = _NOT_DIGIT.sub("", s)
    if kind == 1:
        return all(int(x) <= 255 for x in _DIGITS.findall(s))
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 9 <= len(d) <= 15 and not s.isdigit()


def added_spans(texts: list[str], crf: CRF) -> list[list[Span]]:
    """The field's spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    seqs, ems = [], []
    for i, t in enumerate(texts):
        for lo, hi in windows(t):
            if toks := tokens(t, lo, hi):
                seqs.append((i, toks))
                ems.append(crf.emissions(features(t, toks)))
    for (i, toks), path in zip(seqs, crf.viterbi(ems), strict=True):
        if not path.any():
            continue
        run = 0

        def number(y: int) -> tuple[int, int]:
            nonlocal run
            run += y == 0 or LABELS[y][0] == "B"
            return run, (y + 1) // 2

        at = 0
        for (_, kind), ys in groupby(map(number, path.tolist())):
            n = len(list(ys))
            if kind:
                a, b = toks[at][1], toks[at + n - 1][2]
                if _valid(kind - 1, texts[i][a:b]):
                    out[i].append((kind - 1, a, b))
            at += n
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", crf: CRF | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    model = crf or trained()
    return find_spans(docs, KINDS, base_spans, lambda texts: added_spans(texts, model), id_col, text)
