"""Labelled pages for training: varied layouts whose blocks are known to be main text or not."""

from __future__ import annotations

import html
import random

SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti vo an el in un ter mon sel pra kin dor".split()


class Page:
    """Collects markup, and the text and label of each leaf block in order."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts: list[str] = []
        self.blocks: list[tuple[str, int]] = []

    def words(self, low: int, high: int) -> str:
        count = self.rng.randint(low, high)
        made = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(count)]
        for at in range(9, count - 1, 11):
            made[at] += self.rng.choice((",", ".", ".", ";"))
        return " ".join(made).capitalize()

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.rng.choice("...?!")

    def open(self, tag: str, **names: str) -> None:
        self.parts.append(f"<{tag}" + "".join(f' {name}="{value}"' for name, value in names.items() if value) + ">")

    def close(self, tag: str) -> None:
        self.parts.append(f"</{tag}>")

    def block(self, tag: str, text: str, label: int, inner: str = "") -> None:
        shown = html.escape(text)
        self.parts.append(f"<{tag}>" + (f"<{inner}>{shown}</{inner}>" if inner else shown) + f"</{tag}>")
        self.blocks.append((text, label))

    def links(self, tag: str, count: int, name: str) -> None:
        self.open(tag, **{self.rng.choice(("class", "id")): name})
        self.open("ul")
        for _ in range(count):
            self.block("li", self.words(1, 4), 0, "a")
        self.close("ul")
        self.close(tag)


def _article(page: Page, deep: bool) -> None:
    """The main text itself, with the odd advert or form between its paragraphs."""
    rng = page.rng
    page.block("h1", page.words(3, 12), 1)
    if rng.random() < 0.3:
        page.block("p", page.words(4, 30), 1, "b")
    for _ in range(rng.randint(1, 12)):
        draw = rng.random()
        if draw < 0.68:
            page.block("p", page.sentence(1, 4) if rng.random() < 0.2 else page.sentence(8, 90), 1, rng.choice(("", "", "", "b", "em")))
        elif draw < 0.76:
            page.block(rng.choice(("h2", "h3")), page.words(2, 8), 1)
        elif draw < 0.82:
            page.open("ul")
            for _ in range(rng.randint(2, 5)):
                page.block("li", page.words(2, 18), 1)
            page.close("ul")
        elif draw < 0.86:
            page.block(rng.choice(("blockquote", "pre")), page.sentence(6, 40), 1)
        elif draw < 0.89:
            page.open("table")
            for _ in range(2):
                page.open("tr")
                for _ in range(2):
                    page.block("td", page.words(1, 6), 1)
                page.close("tr")
            page.close("table")
        elif draw < 0.95 or not deep:
            page.open("div", **{"class": rng.choice(("ad", "advert", "ad-slot", "sponsored", "promo banner"))})
            page.block(rng.choice(("p", "span", "div")), page.sentence(3, 40), 0)
            page.close("div")
        else:
            page.open("form", **{"class": rng.choice(("newsletter", "subscribe", ""))})
            page.block("label", page.words(2, 8), 0)
            page.block("button", page.words(1, 2), 0)
            page.close("form")


def _before(page: Page) -> None:
    rng = page.rng
    if rng.random() < 0.3:
        page.open("div", **{rng.choice(("class", "id")): rng.choice(("cookie-notice", "consent", "notice", "gdpr-banner", "alert"))})
        page.block("p", page.sentence(10, 60), 0)
        page.block("button", page.words(1, 2), 0)
        page.close("div")
    if rng.random() < 0.6:
        page.open("header", **{"class": rng.choice(("", "site-header", "masthead"))})
        page.block(rng.choice(("div", "p", "h2")), page.words(1, 6), 0)
        page.close("header")
    if rng.random() < 0.9:
        if rng.random() < 0.6:
            page.links("nav", rng.randint(3, 8), "")
        else:
            page.links("div", rng.randint(3, 8), rng.choice(("menu", "navbar", "breadcrumb", "main-nav")))
    if rng.random() < 0.5:
        page.open("div", **{"class": rng.choice(("ad", "ads", "advertisement", "sponsor"))})
        page.block(rng.choice(("div", "p")), page.sentence(3, 40), 0)
        page.close("div")


def _side(page: Page) -> None:
    rng = page.rng
    page.open(rng.choice(("aside", "aside", "div")), **{"class": rng.choice(("sidebar", "widget-area", "related-posts", "popular"))})
    tag = page.parts[-1][1:].split()[0].rstrip(">")
    page.block("h3", page.words(1, 4), 0)
    for _ in range(rng.randint(1, 4)):
        page.block("p", page.sentence(3, 50), 0, rng.choice(("", "a")))
    page.close(tag)


def _after(page: Page) -> None:
    rng = page.rng
    if rng.random() < 0.25:
        page.open("div", **{"class": rng.choice(("share", "social-links", "tags"))})
        for _ in range(3):
            page.block("p", page.words(1, 2), 0, "a")
        page.close("div")
    if rng.random() < 0.45:
        outer = rng.choice(("section", "div"))
        page.open(outer, **{rng.choice(("class", "id")): rng.choice(("comments", "comment-list", "disqus_thread", "discussion"))})
        page.block("h2", page.words(1, 3), 0)
        for _ in range(rng.randint(1, 5)):
            inner = rng.choice(("article", "div", "li"))
            page.open(inner, **{"class": rng.choice(("comment", "reply", "comment-body"))})
            page.block("p", page.sentence(3, 60), 0)
            page.close(inner)
        page.close(outer)
    if rng.random() < 0.25:
        page.open("form", **{"class": rng.choice(("contact", "comment-form", "search"))})
        page.block("label", page.words(1, 4), 0)
        page.block("button", page.words(1, 2), 0)
        page.close("form")
    if rng.random() < 0.9:
        tag = rng.choice(("footer", "footer", "div"))
        page.open(tag, **{"class": "" if tag == "footer" else rng.choice(("footer", "site-footer", "copyright"))})
        page.block("p", ("© " if rng.random() < 0.7 else "") + page.words(2, 30), 0)
        page.close(tag)


CONTAINERS = (
    ("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"),
    ("div", "article-text"), ("div", "entry-content"), ("section", "story"), ("div", ""), ("section", ""), ("td", ""),
)


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, blocks) of ``count`` pages; blocks are (text, 1 for main text or 0)."""
    made = []
    for number in range(count):
        page = Page(random.Random(seed * 1_000_003 + number))
        rng = page.rng
        page.parts.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' + page.words(3, 9) + "</title></head><body>")
        bare = rng.random() < 0.15  # a page may have nothing around its text
        if not bare:
            _before(page)
        left = not bare and rng.random() < 0.2
        if left:
            _side(page)
        tag, name = rng.choice(CONTAINERS)
        wrapped = rng.random() < 0.3
        if wrapped:
            page.open("div", **{"class": rng.choice(("wrapper", "container", "page", "row"))})
        if tag == "td":
            page.open("table")
            page.open("tr")
        page.open(tag, **{rng.choice(("class", "id")): name})
        _article(page, deep=True)
        page.close(tag)
        if tag == "td":
            page.close("tr")
            page.close("table")
        if wrapped:
            page.close("div")
        if not bare and not left and rng.random() < 0.4:
            _side(page)
        if not bare:
            _after(page)
        page.parts.append("</body></html>")
        made.append(("".join(page.parts), page.blocks))
    return made
