"""Marks of boilerplate around and inside the content, and the stack of open elements against a plain walk."""

import random
import time

import pytest

from territory.llm import html_extract as H

PROSE = [f"Sentence {i} tells, at some length, what happened next; it has commas, too, and it ends here." for i in range(12)]
PARAGRAPHS = "".join(f"<p>{' '.join(PROSE[i : i + 4])}</p>" for i in (0, 4, 8))
ARTICLE = f"<article><h1>A heading of its own</h1>{PARAGRAPHS}</article>"
WANT = H.extract(f"<html><body>{ARTICLE}</body></html>")
MENU = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
FOOT = "<div class='footer'><p>All rights reserved.</p></div>"
COMMENTS = "<div class='comments'>" + "".join(f"<div class='comment'><p>I think, dear author, that this is wrong, and here is why: {s}</p></div>" for s in PROSE * 3) + "</div>"


def test_the_article_itself():
    assert WANT.startswith("A heading of its own\n\nSentence 0") and len(WANT) > 1000


@pytest.mark.parametrize(
    "around",
    [
        "<div class='layout with-header'>{}</div>", "<main class='has-header'>{}</main>", "<div class='container sidebar-right'>{}</div>", "<form id='aspnetForm'>{}</form>", "<div class='page no-sidebar has-comments'>{}</div>",
        "<div id='sidebar-left'><div class='header'>{}</div></div>", "<div role='dialog'><main>{}</main></div>", "<div class='related'><main>{}</main></div>", "<form><div class='menu-wrapper'>{}</div></form>", "<section class='popup overlay'>{}</section>",
    ],
)
def test_marks_around_the_article_drop_nothing(around):
    for page in (around.format(ARTICLE), around.format(MENU + ARTICLE + FOOT), MENU + around.format(ARTICLE + COMMENTS) + FOOT):
        assert H.extract(f"<html><body>{page}</body></html>") == WANT


def test_marks_beside_the_article_hold():
    for beside in ("<form><p>Search our site, find more, and read on.</p></form>", "<div class='sidebar'><p>Popular posts, this week, are here.</p></div>", "<div class='cookie-notice'><p>We use cookies, as you know.</p></div>", "<div role='dialog'><p>Subscribe now, dear reader.</p></div>", COMMENTS):
        assert H.extract(f"<html><body>{beside}{ARTICLE}{beside}</body></html>") == WANT
        assert H.extract(f"<html><body>{ARTICLE[:-10]}{beside}</article></body></html>") == WANT


@pytest.mark.parametrize("part", ["<section id='notices'>{}</section>", "<p id='widgets'>{}</p>", "<div id='login'>{}</div>"])
def test_sections_called_after_their_topic_stay(part):
    prose = " ".join(PROSE[2:7])
    for inner in ([prose] if part.startswith("<p") else [prose, f"<p>{prose}</p>"]):
        page = f"<html><body><article><h1>A heading of its own</h1>{PARAGRAPHS}{part.format(inner)}</article></body></html>"
        assert H.extract(page) == f"{WANT}\n\n{prose}"


def test_a_page_of_comments_is_no_article():
    assert H.extract(f"<html><body><article><h1>Short</h1><p>{PROSE[0]}</p></article>{COMMENTS}</body></html>") == f"Short\n\n{PROSE[0]}"
    assert H.extract(f"<html><body><div class='comments'><article class='comment'><p>{PROSE[1]}</p></article></div>{ARTICLE}</body></html>") == WANT


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<span>" * n + "</b>" * n, lambda n: "<span>" * n + "<div></div>" * n, lambda n: "<b><article>" + "<span>" * n + "</b>" * n, lambda n: "<ul>" + "<span>" * n + "<li>" * n, lambda n: "<svg>" * n, lambda n: "<p><b>" * n + "</i>" * n,
        lambda n: "<div class=sidebar>" * n + "x" * n, lambda n: "<table>" + "<i>" * n + "<tr>" * n + "</td>" * n,
    ],
)
def test_mixed_tags_over_deep_stacks_take_linear_time(page):
    def took(n):
        began = time.process_time()
        H.extract(page(n))
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 5  # a quadratic walk took a minute


class Plain:
    """The same rules of closing, each a walk down the whole stack."""

    def __init__(self):
        self.open = [""]

    def close(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i] == tag:
                del self.open[i:]
                return
            if self.open[i] in ("article", "main", "body") and tag not in H.BLOCKS:
                return

    def make_room(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if tag in H.BLOCKS and self.open[i] in H.BLOCKS:
                if self.open[i] == "p":
                    del self.open[i:]
                break
        again = tag in H._CLOSES
        while again:
            again = False
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i] in H._STOPS[tag]:
                    break
                if self.open[i] in H._CLOSES[tag]:
                    del self.open[i:]
                    again = tag == "tr"
                    break


def test_the_stack_is_that_of_a_plain_walk():
    r = random.Random(8)
    tags = "p div span b i li ul td tr table article main body dt dd dl option select th section".split()
    for _ in range(300):
        ours, plain = H._Stack(), Plain()
        for _ in range(60):
            tag = r.choice(tags)
            if r.random() < 0.4:
                ours.close(tag)
                plain.close(tag)
            else:
                ours.make_room(tag)
                plain.make_room(tag)
                ours.push(H._Open(tag, 0, 0, 0, False, False, 0))
                plain.open.append(tag)
            assert [e.tag for e in ours.open] == plain.open
            assert ours.blocks == [i for i, t in enumerate(plain.open) if t in H.BLOCKS] and ours.bounds == [i for i, t in enumerate(plain.open) if t in H._BOUNDS]
