"""Op 2. HTML extraction by tag-path ratios.

One pass over the page keeps the stack of open elements. A tag path goes from the root to the element that holds a text
node; a step is the tag, for containers with its id or class. Menus, footers, sidebars, hidden and raw elements are boilerplate
by tag, and their text takes no part. Forms, and elements that a role, class or id calls a menu, header, sidebar, notice,
advert or comment, are marked so; a mark holds unless the page's content is below it (``Marks``: a main element, an article,
or half of the page's weight), as it is where a wrapper tells of its layout; classes like ``has-sidebar`` mark nothing. Text
below marks that hold takes no part. For every other path the text's length and punctuation are summed over its text nodes. The score of every page's every path is made so:

1. ratios: characters a node and punctuation marks a node;
2. smoothing: both over the paths next to it in the page (Gaussian weights, ``REACH`` to each side);
3. fusing: ratio of length x (1 + ratio of punctuation), and on top of it a prior times the page's best such value. The
   prior is 1 inside what the page marks as its article, and the share of the page's weight below the content root for paths
   there: the deepest container that holds at least ``SHARE`` of the weight (fused ratio x nodes). An element whose class or
   id names boilerplate beside words of its own (``share-story``) has no prior: its ratios alone decide;
4. threshold: paths that reach ``LAMBDA`` standard deviations of the fused ratios are content. Headings beside content that
   has no prior are content, too.

A standard deviation is at most half of the best value, so a prior of ``SHARE`` always reaches the threshold: nothing in the
article or below the content root is dropped for being short.

The text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones
dropped and the rest joined in page order by a blank line. Nothing else is dropped or capped.

Defined results: null or empty html has empty text; broken markup is read as far as a browser would (an unclosed comment
or script runs to the end); repeated rows are judged one by one; a null url stays null; extra columns are not read. Time
and memory are linear in the page, however deep its elements: paths are numbers with a parent each.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDA, SIGMA, REACH, SHARE = 0.8, 0.5, 2, 0.5

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILER = set("nav footer aside head script style noscript template iframe svg math canvas object select option button textarea menu dialog audio video search title".split())
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu footer sidebar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus breadcrumb breadcrumbs pagination pager widget widgets toolbar masthead topbar disclaimer".split()
)
#: Of these, the ones that make an article element boilerplate.
ARTICLE_BOILER = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related", "recommended"}
#: Marks by these words hold whatever the weight below them: readers write a lot.
STRONG_WORDS = ARTICLE_BOILER | {"commentlist", "respond", "disqus", "adverts", "advertisement", "adsense", "share", "sharing", "newsletter", "cookie", "cookies", "consent", "gdpr", "recommendations"}
#: Words that a section of an article may be about, as its id tells: its ratios decide then.
TOPIC_WORDS = set("notice notices alert widget widgets banner disclaimer menu navigation overlay popup modal toolbar social login promotion subscription advertising".split())
#: A class that begins so tells what stands beside or around an element, not what it is.
BESIDE_WORDS = {"has", "have", "no", "not", "with", "without", "show", "hide", "is", "enable", "disable"}
#: Words that say nothing beside boilerplate's: with these alone a class is boilerplate for sure.
NEUTRAL_WORDS = set(
    "list lists box boxes container wrapper wrap section sections area block blocks bar links link posts post articles items item site page top bottom left right inner outer holder panel unit units slot slots form thread "
    "threads text message messages header head title body button buttons icon icons reader readers user users global primary secondary main middle center row col column group set tab tabs fixed sticky js the by of and our your for "
    "google media inline".split()
)
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements beyond which an inline closing tag closes nothing.
_BOUNDS = {"article", "main", "body"}
#: Elements that a new one of the same group closes, as browsers do.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_SIMPLE = re.compile(r"<[^>\"']*+>")
_QUOTED = re.compile(r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCT = re.compile(r"[.,;:!?¿¡…、。]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Tags that can be a content root, whose class or id is part of the path.
CONTAINERS = set("article center div dl main ol section table tbody td tr ul blockquote details fieldset figure".split())

_CLEAR, _SUSPECT, _SOFT, _BOILER = 0, 1, 2, 3


class _Open(NamedTuple):
    """What stands on the stack: path is a number of ``Paths``, boiler one of the four above, article 2 inside an article
    element and 1 inside another mark of the article, mark a number of ``Marks``."""

    tag: str
    path: int
    boiler: int
    article: int
    header: bool
    heading: bool
    mark: int


class Marks:
    """Elements that a class, an id, a role or a form marks as boilerplate or as a header. A mark does not hold where the page's
    content is below it: where a main element is, or, unless its words are strong, an article or half of the page's weight
    (characters that are not below a strong mark). Number 0 is no mark."""

    def __init__(self) -> None:
        self.parent, self.header, self.strong = [0], [False], [False]
        self.main, self.article, self.weight = [False], [False], [0]

    def add(self, parent: int, header: bool, strong: bool) -> int:
        for of, x in ((self.parent, parent), (self.header, header), (self.strong, strong), (self.main, False), (self.article, False), (self.weight, 0)):
            of.append(x)
        return len(self.parent) - 1

    def held(self) -> tuple[list[bool], list[bool]]:
        """By number: is there a mark of boilerplate, and one of a header, that holds, there or around it?"""
        n = len(self.parent)
        below_strong = list(self.strong)
        for m in range(1, n):
            below_strong[m] = below_strong[m] or below_strong[self.parent[m]]
        for m in range(n - 1, 0, -1):  # a mark's number is larger than its parent's
            p = self.parent[m]
            self.main[p] = self.main[p] or self.main[m]
            if not self.strong[m]:
                self.article[p] = self.article[p] or self.article[m]
                self.weight[p] += self.weight[m]
        boiler, header = [False] * n, [False] * n
        for m in range(1, n):
            around = self.main[m] or not self.strong[m] and (self.article[m] or not below_strong[m] and self.weight[m] >= SHARE * self.weight[0] > 0)
            boiler[m] = boiler[self.parent[m]] or not around and not self.header[m]
            header[m] = header[self.parent[m]] or not around and self.header[m]
        return boiler, header


class Paths:
    """The tag paths of a page: a number for each, its parent and its last step. Number 0 is the root's parent."""

    def __init__(self) -> None:
        self.parent, self.tag, self._at = [-1], [""], {}

    def step(self, parent: int, tag: str, name: str) -> int:
        at = self._at.get((parent, tag, name))
        if at is None:
            at = self._at[parent, tag, name] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
        return at


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value) if not w.isdigit()}


def _named(values: list[str]) -> tuple[int, set[str]]:
    """Whether classes and ids name boilerplate, softly (other marks of the page can overrule it) if one has no word of its own
    beside it; and the words of boilerplate among them."""
    found, said = _CLEAR, set()
    for token in " ".join(values).split():
        first = _WORD.match(token)
        words = _words(token)
        if first and first[0].lower() in BESIDE_WORDS:
            continue
        if own := words & BOILER_WORDS:
            said |= own
            found = max(found, _SOFT if words - own <= NEUTRAL_WORDS else _SUSPECT)
    return found, said


def _opened(tag: str, attrs: str, inside: _Open, paths: Paths, marks: Marks) -> _Open:
    boiler, article, mark = inside.boiler, inside.article, inside.mark
    plain, names, marked, soft, said, ids = tag in ("html", "body"), [], tag in ("article", "main"), tag == "form", set(), False
    if boiler < _BOILER and tag in BOILER:
        boiler = _BOILER
    header = False
    if boiler < _BOILER and attrs and not attrs.isspace():
        classes = False
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names.append(value)
                classes, ids = classes or name == "class", ids or name == "id"
            elif name == "role" and (role := value.strip().lower()) and not plain:
                marked = marked or role in ("main", "article")
                soft = soft or role in BOILER_ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                boiler = _BOILER
        if names and not plain and tag != "main":
            # an article may be called after its place or its topic, if it isn't called a comment or an advert
            named, said = _named(names)
            if tag == "article" and not said & ARTICLE_BOILER:
                named, said = _CLEAR, set()
            if named == _SOFT and ids and not classes and article and tag in ("section", "p", "div") and said <= TOPIC_WORDS:
                named = _SUSPECT
            soft = soft or named == _SOFT
            boiler = max(boiler, _SUSPECT) if named == _SUSPECT else boiler
            header = tag not in HEADINGS and any("header" in _words(t) and (m := _WORD.match(t)) and m[0].lower() not in BESIDE_WORDS for v in names for t in v.split())
    if tag == "article" and article == 2:
        boiler = _BOILER  # an article inside an article is a comment on it
    if boiler < _BOILER:
        if soft or header:
            mark = marks.add(mark, header and not soft, bool(said & STRONG_WORDS))
        if tag == "main" or marked and tag != "article":
            marks.main[mark] = True
        elif tag == "article" and not said:
            marks.article[mark] = True
    heading = inside.heading or tag in HEADINGS
    path = paths.step(inside.path, tag, " ".join(names) if tag in CONTAINERS else "") if boiler < _BOILER else inside.path
    return _Open(tag, path, boiler, max(article, 2 if tag == "article" else int(marked)), inside.header or tag == "header", heading, mark)


class _Stack:
    """The open elements, and where each tag, each block and each boundary stands among them, so that a tag asks for no more
    than what it closes."""

    def __init__(self) -> None:
        self.open: list[_Open] = [_Open("", 0, _CLEAR, 0, False, False, 0)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bounds: list[int] = []

    def push(self, el: _Open) -> None:
        i = len(self.open)
        self.at.setdefault(el.tag, []).append(i)
        if el.tag in BLOCKS:
            self.blocks.append(i)
        if el.tag in _BOUNDS:
            self.bounds.append(i)
        self.open.append(el)

    def cut(self, i: int) -> None:
        """Close all from the i-th on."""
        for el in self.open[i:]:
            self.at[el.tag].pop()
        for of in (self.blocks, self.bounds):
            while of and of[-1] >= i:
                of.pop()
        del self.open[i:]

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tag: str) -> None:
        """A closing tag: what no open element has closes nothing, and an inline one nothing beyond its article."""
        i = self.last((tag,))
        if i and (tag in BLOCKS or not self.bounds or self.bounds[-1] <= i):
            self.cut(i)

    def make_room(self, tag: str) -> None:
        """What a new element closes: a block an open paragraph, an item the one before."""
        if tag in BLOCKS and self.blocks and self.open[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        while tag in _CLOSES and (i := self.last(_CLOSES[tag])) > self.last(_STOPS[tag]):
            self.cut(i)
            if tag != "tr":
                break


def chunks(page: str, paths: Paths, marks: Marks) -> Iterator[tuple[_Open | None, str]]:
    """The page's text nodes with the innermost open element; (None, "") where a block begins or ends."""
    elements = _Stack()
    stack, unclosed = elements.open, set()
    lower, pos, n, quotes = None, 0, len(page), True
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            yield stack[-1], page[pos:lt]
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in "!?" and nxt:
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, lt)
        if not name:
            yield stack[-1], "<"
            pos = lt + 1
            continue
        m = _SIMPLE.match(page, lt) or (_QUOTED.match(page, lt) if quotes else None)
        if not m:
            quotes = False  # a quote that nothing closes: from here on tags end at the first >
            end = page.find(">", lt)
            if end < 0:
                return
            end += 1
        else:
            end = m.end()
        tag, closing, pos = name[1].lower(), page[lt + 1] == "/", end
        if closing:
            if tag in BLOCKS:
                yield None, ""
            if tag == "br":
                yield stack[-1], " "
            elements.close(tag)
            continue
        if tag in BLOCKS:
            yield None, ""
        elements.make_room(tag)
        attrs = page[name.end() : end - 1]
        if tag in VOID:
            if tag == "br":
                yield stack[-1], " "
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower() if page.isascii() else page.translate(_ASCII_LOWER)
            close = -1 if tag in unclosed else lower.find(f"</{tag}", end)
            if close < 0:
                unclosed.add(tag)
                if tag in ("svg", "math", "template", "noscript"):
                    continue
                return
            gt = page.find(">", close)
            pos = n if gt < 0 else gt + 1
            continue
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        elements.push(_opened(tag, attrs, stack[-1], paths, marks))


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def path_ratios(sums: list[tuple[int, int, int]]) -> list[float]:
    """Smoothed and fused ratios of paths in page order; each has (text length, punctuation, nodes)."""
    length = [c / n for c, _, n in sums]
    punct = [p / n for _, p, n in sums]
    weight = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(REACH + 1)]

    def smooth(x: list[float]) -> list[float]:
        out = []
        for i in range(len(x)):
            near = [(x[j], weight[abs(i - j)]) for j in range(max(0, i - REACH), min(len(x), i + REACH + 1))]
            out.append(sum(a * w for a, w in near) / sum(w for _, w in near))
        return out

    return [a * (1 + b) for a, b in zip(smooth(length), smooth(punct), strict=True)]


def below_root(own: list[int], weights: list[float], paths: Paths) -> tuple[set[int], float]:
    """Of the paths ``own``, those below the content root, and the root's share of the weight; none if no container has
    enough."""
    weight = [0.0] * len(paths.parent)
    for p, w in zip(own, weights, strict=True):
        weight[p] += w
    for p in range(len(weight) - 1, 0, -1):  # a path's number is larger than its parent's
        weight[paths.parent[p]] += weight[p]
    root, least = 0, SHARE * weight[0]
    for p in range(1, len(weight)):  # those that hold half are on one way down, but for two equal halves: the first counts
        if weight[p] >= least > 0 and paths.tag[p] in CONTAINERS and _is_below(p, root, paths):
            root = p
    if not root:
        return set(), 0.0
    inside = [False] * len(weight)
    inside[root] = True
    for p in range(root + 1, len(weight)):
        inside[p] = inside[paths.parent[p]]
    return {p for p in own if inside[p]}, weight[root] / weight[0]


def _is_below(p: int, root: int, paths: Paths) -> bool:
    while p > root:
        p = paths.parent[p]
    return p == root


def select(keys: list[tuple[int, bool, bool]], sums: list[tuple[int, int, int]], paths: Paths) -> set[tuple[int, bool, bool]]:
    """The keys (path, inside an article, suspect) whose score reaches the threshold."""
    if not keys:
        return set()
    ratio = path_ratios(sums)
    top, mean = max(ratio), sum(ratio) / len(ratio)
    bar = LAMBDA * math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio))
    clear = [i for i, k in enumerate(keys) if not k[2]]
    below, share = below_root([keys[i][0] for i in clear], [ratio[i] * sums[i][2] for i in clear], paths)
    prior = [0.0 if suspect else 1.0 if article else share if path in below else 0.0 for path, article, suspect in keys]
    return {k for k, x, y in zip(keys, ratio, prior, strict=True) if x + y * top >= bar}


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes: list[tuple[tuple[int, bool, bool] | None, str]] = []
    sums: dict[tuple[int, bool, bool], list[int]] = {}
    headings: set[tuple[int, bool, bool]] = set()
    paths, marks, met = Paths(), Marks(), []
    for el, raw in chunks(page, paths, marks):
        if el is None or el.boiler < _BOILER and not (el.header and (not el.heading or not el.article)):
            text = _html.unescape(raw) if "&" in raw else raw
            met.append((el, text))
            if el is not None:
                marks.weight[el.mark] += len(text.strip())
        elif el.boiler < _BOILER and not raw.strip() and el.heading:
            met.append((el, raw))
    boiler, header = marks.held()
    for el, text in met:
        if el is None:
            if nodes and nodes[-1][0] is not None:
                nodes.append((None, ""))
            continue
        if boiler[el.mark] or header[el.mark] and not el.heading:
            continue
        if header[el.mark] and not el.article and text.strip():
            continue  # the heading of the site's own header
        key = el.path, el.article > 0, el.boiler == _SUSPECT
        nodes.append((key, text))
        if s := text.strip():
            t = sums.setdefault(key, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + len(s), t[1] + len(_PUNCT.findall(s)), t[2] + 1
            if el.heading:
                headings.add(key)
    chosen = select(list(sums), [tuple(x) for x in sums.values()], paths)
    beside = {paths.parent[k[0]] for k in chosen if not k[1]}
    chosen |= {k for k in headings if not k[1] and not k[2] and paths.parent[k[0]] in beside}
    blocks, at = [], []
    for key, text in [*nodes, (None, "")]:
        if key is not None:
            if key in chosen or not text.strip():
                at.append(text)
        elif at:
            if b := " ".join("".join(at).split()):
                blocks.append(b)
            at = []
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url, "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url)}
    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{url}`"), F.col(f"`{html}`").cast("string")).mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url}` {kind[url]}, text string, n_chars long")
