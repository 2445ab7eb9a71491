import math
import os
import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from territory.llm import html_extract as H

PARA = "Long prose, with commas, stops and more words than any menu would have. It goes on, and on, for a while."

CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav><div class='ad'>Buy, now.</div><article><h1>Head</h1><p><b>One<br>two\n three<p>&amp;&lt;b&gt; &eacute;</article><footer>&copy; f</footer></body></html>", "Head\n\nOne two three\n\n&<b> é"),
    (f"<body><header><h1>Site</h1></header><main><header><h1>Title</h1><p>by me</p></header><p>{PARA}</p><aside>side</aside><form><p>mail?</p></form><section id='reader-comments'><article><p>first!</p></article></section></main></body>", f"Title\n\n{PARA}"),
    (f"<article><p>{PARA}</p><article class='comment'><p>I, too, have a comment. Really.</p></article><div class='cookie-notice'>ok?</div></article>", PARA),
    (f"<body class='has-sidebar'><div id='top'><a>x</a><a>y</a></div><div class='c'><h2>Head</h2><p>{PARA}</p><p>{PARA}</p><p>Short.</p></div><div class='sidebar'><p>{PARA}</p></div><ul><li><a>a</a><li><a>b</a></ul></body>", f"Head\n\n{PARA}\n\n{PARA}\n\nShort."),
    ("<article><p>a<!-- <p>no</p> -->b<!-- open", "ab"),
    ("<article><p>a < b & c > d</p><p hidden>no</p><p style='display: none'>no</p>", "a < b & c > d"),
    ('<article><p title="a>b">x</p><p class="open>y</p>', "x\n\ny"),
    ("<article><table><tr><td>a<td>b</table><ul><li>c<li>d</ul><p>e</p><pre>f\n g</pre>", "a\n\nb\n\nc\n\nd\n\ne\n\nf g"),
    ("<article><p>a<svg><text>no</text></svg>b</p><script>if (a<b) {}</script><p>c", "ab\n\nc"),
    ("<article></p></div>x</article>", "x"),
]


def test_teaser_article_does_not_hide_the_body():
    page = f"<body><article><p>Read on.</p></article><div id='content'><h2>Head</h2><p>{PARA}</p><p>{PARA}</p></div><div><span>x</span></div></body>"
    assert H.extract(page) == f"Read on.\n\nHead\n\n{PARA}\n\n{PARA}"


def test_names_beside_words_of_their_own_leave_prose_alone():
    for mark in ("id='related-work'", "class='share-story'", "id='comments-on-method'", "class='ad-hoc-notes'"):
        assert H.extract(f"<article><p>{PARA}</p><div {mark}><p>{PARA}</p></div></article>") == f"{PARA}\n\n{PARA}", mark
    for mark in ("class='cookie-notice'", "id='reader-comments'", "class='ad-container'", "class='x related-posts'", "class='newsletter_signup'", "class='social-share-links'", "class='acme-promo'"):
        assert H.extract(f"<article><p>{PARA}</p><p>{PARA}</p><div {mark}><span>Buy now</span></div></article>") == f"{PARA}\n\n{PARA}", mark


class Plain(HTMLParser):
    """The text nodes of a well-formed page, each with its path of steps."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.found = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        names = " ".join(v for k, v in attrs if k in ("class", "id"))
        self.stack.append((tag, names if tag in H.CONTAINERS else ""))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append((tuple(self.stack), data.strip()))


def brute(page):
    """The chosen paths by the docstring's four steps, written out."""
    found = Plain(page).found
    keys = list(dict.fromkeys(k for k, _ in found))
    texts = {k: [t for q, t in found if q == k] for k in keys}
    length = [sum(map(len, texts[k])) / len(texts[k]) for k in keys]
    punct = [sum(c in ".,;:!?" for t in texts[k] for c in t) / len(texts[k]) for k in keys]
    gauss = {d: math.exp(-d * d / 0.5) for d in (-2, -1, 0, 1, 2)}

    def smooth(x):
        return [sum(gauss[j - i] * x[j] for j in range(len(x)) if abs(i - j) <= 2) / sum(gauss[j - i] for j in range(len(x)) if abs(i - j) <= 2) for i in range(len(x))]

    ratio = [a * (1 + b) for a, b in zip(smooth(length), smooth(punct), strict=True)]
    weight = {}
    for k, x in zip(keys, ratio, strict=True):
        for n in range(len(k) + 1):
            weight[k[:n]] = weight.get(k[:n], 0) + x * len(texts[k])
    roots = [q for q, w in weight.items() if q and q[-1][0] in H.CONTAINERS and w >= weight[()] / 2]
    root = max(roots, key=len) if roots else None
    mean = sum(ratio) / len(ratio)
    bar = 0.8 * math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio))
    out = set()
    for k, x in zip(keys, ratio, strict=True):
        prior = 1 if any(t == "article" for t, _ in k) else weight[root] / weight[()] if root and k[: len(root)] == root else 0
        if x + prior * max(ratio) >= bar:
            out.add(k)
    return [t for k, t in found if k in out]


def test_scores_match_brute_force():
    r = random.Random(4)

    def text():
        return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", ",", "."]) for _ in range(r.choice([1, 2, 4, 30, 80])))

    def element(depth):
        tag = r.choice(["div", "div", "div class=c1", "div id=main2", "section", "p", "p", "p", "span", "ul"] + ["article"] * (depth == 1))
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        inner = text() if depth > 4 or tag in ("p", "span") else "".join(element(depth + 1) for _ in range(r.randint(1, 4)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    dropped = 0
    for _ in range(400):
        page = "<html><body>" + "".join(element(0) for _ in range(r.randint(1, 5))) + "</body></html>"
        want = brute(page)
        dropped += len(Plain(page).found) - len(want)
        assert "".join(H.extract(page).split()) == "".join("".join(want).split())
    assert dropped > 100


REAL = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(REAL), reason="no test pages")
def test_every_real_page_is_scored_and_needs_no_article_mark(monkeypatch):
    calls, ratios = [], H.path_ratios
    monkeypatch.setattr(H, "path_ratios", lambda sums: calls.append(1) or ratios(sums))
    pages = [p for p in pq.read_table(REAL, columns=["html"]).column(0).to_pylist() if p]
    marked = [H.extract(p) for p in pages]
    assert len(calls) == len(pages)
    assert [H.extract(p.replace("<article", "<div").replace("</article", "</div")) for p in pages] == marked


@pytest.mark.parametrize("page,want", CASES)
def test_extract(page, want):
    assert H.extract(page) == want


def test_long_broken_pages_take_linear_time():
    for part in ("<p>", "<div>", "<!--", '<a "', "<script>", "<div><p>", "</p>", "&amp;", "<", "<b", "<li>"):
        t = time.time()
        H.extract("<article>" + part * 30_000)
        assert time.time() - t < 20, part


def test_table(spark):
    rows = [(1, "u", CASES[3][0], "x"), (None, None, None, "y"), (1, "u", CASES[3][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted(map(tuple, got.collect()), key=str)
    assert out == sorted([(1, "u", CASES[3][1], len(CASES[3][1])), (None, None, "", 0), (1, "u", CASES[3][1], len(CASES[3][1]))], key=str)
    assert H.main_text(df.limit(0)).count() == 0
