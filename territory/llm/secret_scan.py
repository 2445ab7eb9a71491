"""Op 7. Secret scans: probabilistic automata inferred from labelled credentials score every candidate's format.

Grammar inference: the credentials of each labelled format (``labelled_table``: made by rule from a fixed seed, ``SAMPLES`` a
format) make a prefix tree with counts, whose edges are symbol kinds: letters and digits are one, every sign is its own.
States are taken by breadth; one whose frequencies (of ends, symbols and classes of symbols) are statistically compatible
with an earlier one's here and all the way down is merged with it (Hoeffding bounds at ``ALPHA``), else it stays a state of
its own, so that places and lengths that all samples share are states. Nothing is concluded from fewer than ``SUPPORT``
samples: such a state goes on as its most frequent sibling, of the same place, or, without one, as the state before it.
A state's symbols have the probabilities of its samples, smoothed towards those of their classes.

A candidate is every whole run of ``[A-Za-z0-9+/_=.-]`` of 16 or more characters, anywhere in a text, and its parts between
``=`` and ``/`` signs, the best of which counts; the score is the best
log-likelihood under any credential format less the best under the automata of other long runs, random ones among them, so
what counts is a format's own prefix, places and length. Candidates of ``THRESHOLD`` nats are added where they meet no base
span; base spans always stay.

Defined results: null text is empty; ids may be null; repeated rows are judged one by one; other columns are not read; an
empty table gives an empty table. The n_ columns and base_sha256 tell of the base spans alone, n_spans counts all spans.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import defaultdict, deque
from functools import lru_cache

from pyspark.sql import DataFrame

from territory.llm.spans import Span, find_spans

KINDS = ("assign", "access", "hex")
#: The added spans' kind.
ALL_KINDS = (*KINDS, "format")
ALPHA, SAMPLES, SUPPORT, THRESHOLD = 0.05, 250, 24, 3.0
#: Probability of a symbol kind that a state never had; weights of the smoothing by classes and over all symbols.
FLOOR, BY_CLASS, OVERALL = 1e-4, 60.0, 1.0

_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_BETWEEN, _SEGMENT = re.compile(r"[A-Za-z0-9+/_.-]{16,}=*"), re.compile(r"[A-Za-z0-9+_.-]{16,}=*")
#: The symbols of runs by class; those of the first five are one kind.
_CLASSES = (string.digits, "abcdef", string.ascii_lowercase[6:], "ABCDEF", string.ascii_uppercase[6:], *"+/_=.-")
_CLASS = {ch: k for k, chs in enumerate(_CLASSES) for ch in chs}


def base_spans(t: str) -> list[Span]:
    out = []
    if "=" in t or ":" in t:
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in t:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 18]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(t)]
    return out


def labelled_table(samples: int = SAMPLES, seed: int = 5) -> list[tuple[str, str]]:
    """(format, credential): made by rule."""
    r = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    word, hexa = low + up + dig, dig + "abcdef"
    part = lambda a, b: some(word, r.randint(a, b))
    forms = {
        "access_key": lambda: r.choice(["AKIA", "ASIA"]) + some(up + dig, 16),
        "git_token": lambda: f"gh{r.choice('pousr')}_" + some(word, 36),
        "git_fine_token": lambda: f"github_pat_{some(word, 22)}_{some(word, 59)}",
        "lab_token": lambda: "glpat-" + some(word + "_-", 20),
        "chat_token": lambda: f"xox{r.choice('bp')}-{some(dig, r.randint(10, 13))}-{some(dig, r.randint(10, 13))}-{some(word, 24)}",
        "pay_key": lambda: f"{r.choice(['sk', 'rk', 'pk'])}_{r.choice(['live', 'test'])}_" + some(word, 24),
        "map_key": lambda: "AIza" + some(word + "_-", 35),
        "package_token": lambda: "npm_" + some(word, 36),
        "mail_key": lambda: f"SG.{some(word + '_-', 22)}.{some(word + '_-', 43)}",
        "web_token": lambda: f"eyJ{part(14, 33)}.eyJ{part(24, 90)}.{some(word + '_-', 43)}",
        "uuid": lambda: "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12)),
        "base64_key": lambda: some(word + "+/", r.choice([31, 39, 43])) + "=",
        "base64_pair": lambda: some(word + "+/", r.choice([22, 42, 86])) + "==",
    }
    return [(k, f()) for k, f in forms.items() for _ in range(samples)]


class Automaton:
    """States with symbol counts, ends and a target for each kind of symbol, as merging leaves them; then log-probabilities."""

    def __init__(self, words: list[str], alpha: float = ALPHA, support: int = SUPPORT) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.end = [0]
        self.support, self.bound = support, math.sqrt(0.5 * math.log(2 / alpha))
        for w in words:
            s = 0
            for ch in w:
                self.count[s][ch] += 1
                k = self.kind(ch)
                if k not in self.next[s]:
                    self.next[s][k] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.end.append(0)
                s = self.next[s][k]
            self.end[s] += 1
        self._infer()
        self.logs = self._logs()

    @staticmethod
    def kind(ch: str) -> int:
        return max(4, _CLASS[ch])

    def _total(self, s: int) -> int:
        return self.end[s] + sum(self.count[s].values())

    def _by_kind(self, s: int) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for ch, n in self.count[s].items():
            out[self.kind(ch)] += n
        return out

    def _frequencies(self, s: int) -> dict[str | int, int]:
        """How often the state's samples end, and go on with each symbol and each class."""
        out: dict = dict(self.count[s])
        out[-1] = self.end[s]
        for ch, n in self.count[s].items():
            out[_CLASS[ch]] = out.get(_CLASS[ch], 0) + n
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Do the frequencies agree here and at all states below, as far as both have enough samples?"""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n1, n2 = self._total(a), self._total(b)
            if min(n1, n2) < self.support:
                continue
            far, f1, f2 = self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2)), self._frequencies(a), self._frequencies(b)
            if any(abs(f1.get(x, 0) / n1 - f2.get(x, 0) / n2) > far for x in f1.keys() | f2.keys()):
                return False
            todo += [(self.next[a][k], self.next[b][k]) for k in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.end[a] += self.end[b]
            for ch, n in self.count[b].items():
                self.count[a][ch] += n
            for k, t in self.next[b].items():
                if k in self.next[a]:
                    todo.append((self.next[a][k], t))
                else:
                    self.next[a][k] = t

    def _infer(self) -> None:
        red, todo = [0], deque([(0, k) for k in sorted(self.next[0])])
        while todo:
            src, k = todo.popleft()
            b = self.next[src][k]
            if b in red:
                continue
            if self._total(b) < self.support:
                often = self._by_kind(src)
                top = max(often, key=lambda x: (often[x], -x))
                a = src if top == k else self.next[src][top]
            else:
                a = next((x for x in red if self.compatible(x, b)), None)
            if a is None:
                red.append(b)
                todo.extend((b, x) for x in sorted(self.next[b]))
                continue
            self.next[src][k] = a
            self._fold(a, b)
            have = set(todo)
            todo.extend((x, y) for x in red for y in sorted(self.next[x]) if self.next[x][y] not in red and (x, y) not in have)
        self.states = red

    def _logs(self) -> list[tuple[dict[str, tuple[float, int]], float, int]]:
        """Of every state the log-probability and target of its symbols, that of an end, and the most frequent target."""
        at, size, out = {s: i for i, s in enumerate(self.states)}, len(_CLASS) + 1, []
        for s in self.states:
            n, by = self._total(s), defaultdict(float)
            for ch, c in self.count[s].items():
                by[_CLASS[ch]] += c
            go = {}
            for ch, k in _CLASS.items():
                if (t := self.next[s].get(self.kind(ch))) is not None:
                    of_class = (by[k] + OVERALL * len(_CLASSES[k]) / size) / (n + OVERALL) / len(_CLASSES[k])
                    go[ch] = math.log((self.count[s].get(ch, 0) + BY_CLASS * of_class) / (n + BY_CLASS)), at[t]
            often = self._by_kind(s)
            top = at[self.next[s][max(often, key=lambda x: (often[x], -x))]] if often else at[s]
            out.append((go, math.log((self.end[s] + OVERALL / size) / (n + OVERALL)), top))
        return out

    def score(self, w: str) -> float:
        """Log-likelihood; a kind of symbol that a state never had costs FLOOR and goes on as the state's most frequent one."""
        s, total, miss = 0, 0.0, math.log(FLOOR)
        for ch in w:
            step, s = self.logs[s][0].get(ch) or (miss, self.logs[s][2])
            total += step
        return total + self.logs[s][1]


class Scanner:
    """The automata of every labelled format: those of credentials and those of long runs that are none."""

    def __init__(self, table: list[tuple[str, str]], background: list[tuple[str, str]]) -> None:
        self.automata, self.background = self._by_format(table), self._by_format(background)

    @staticmethod
    def _by_format(table: list[tuple[str, str]]) -> dict[str, Automaton]:
        by = defaultdict(list)
        for k, w in table:
            by[k].append(w)
        return {k: Automaton(ws) for k, ws in by.items()}

    def score(self, w: str) -> float:
        """Best log-likelihood ratio between the formats of credentials and the others."""
        return max(a.score(w) for a in self.automata.values()) - max(a.score(w) for a in self.background.values())


def background_table(samples: int = SAMPLES, seed: int = 6) -> list[tuple[str, str]]:
    """(format, run) of long runs that are no credentials: joined words, paths, file names, numbers, random symbols of no
    format; made by rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("eeeettaaoinshrdlucmfwypvbgk") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice(string.digits) for _ in range(k))
    forms = {
        "slug": lambda: "-".join(word() for _ in range(4)) + "-" + num(2),
        "path": lambda: "/".join(word() for _ in range(4)) + num(1),
        "file": lambda: "_".join(word() for _ in range(3)) + num(3) + ".txt",
        "words": lambda: "".join(word() for _ in range(4)) + num(2),
        "number": lambda: num(r.randint(12, 24)),
        "dated": lambda: f"{num(4)}-{num(2)}-{num(2)}-{word()}-{word()}",
        "dotted": lambda: ".".join(word() for _ in range(4)) + num(1),
        "camel": lambda: word().title() + word().title() + word().title() + num(2),
        "upper": lambda: word().upper() + "_" + word().upper() + "_" + num(4),
        "host": lambda: f"{word()}{num(r.randint(0, 2))}.{word()}.{r.choice(['com', 'org', 'net', 'example.com'])}",
        "url": lambda: f"{word()}.{word()}.{r.choice(['com', 'org', 'net'])}/{word()}/{num(r.randint(1, 4))}.html",
        "random": lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(12, 90))),
        "random_low": lambda: "".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(r.randint(12, 90))),
        "random_up": lambda: "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(r.randint(12, 60))),
        "random_hex": lambda: "".join(r.choice(string.digits + "abcdef") for _ in range(r.randint(12, 90))),
        "random_signs": lambda: "".join(r.choice(string.ascii_letters + string.digits + "+/_-.=") for _ in range(r.randint(12, 90))),
        "long_word": lambda: "".join(word() for _ in range(3)).capitalize(),
        "rule": lambda: r.choice("-=_.+") * r.randint(16, 80),
        "setting": lambda: word() + "=" + word() + num(3) + word(),
    }
    return [(k, f()) for k, f in forms.items() for _ in range(samples)]


@lru_cache(maxsize=1)
def trained() -> Scanner:
    return Scanner(labelled_table(), background_table())


def candidates(t: str) -> list[list[tuple[int, int]]]:
    """Of every long run the places to score: the run, and its parts between ``=`` and between ``=`` and ``/`` signs."""
    out = []
    for m in _RUN.finditer(t):
        found = {}
        for part in (_RUN, _BETWEEN, _SEGMENT):
            for x in part.finditer(t, m.start(), m.end()):
                end = x.start() + len(x[0].rstrip(".-"))  # the end of a sentence is no part of a credential
                if end - x.start() >= 16:
                    found[x.start(), end] = None
        out.append(list(found))
    return out


def added_spans(texts: list[str], scanner: Scanner, threshold: float = THRESHOLD) -> list[list[Span]]:
    """The best candidate of each run that reaches the threshold."""
    out: list[list[Span]] = []
    for t in texts:
        found = []
        for places in candidates(t):
            score, a, b = max(((scanner.score(t[a:b]), -a, b) for a, b in places), default=(-math.inf, 0, 0))
            if score >= threshold:
                found.append((len(KINDS), -a, b))
        out.append(found)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scanner: Scanner | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_format, base_sha256, spans, n_spans) of every row; n_format is of no base kind and 0."""
    model = scanner or trained()
    return find_spans(docs, ALL_KINDS, base_spans, lambda texts: added_spans(texts, model, threshold), id_col, text)
