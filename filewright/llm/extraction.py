"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks, the runs of text between block tags, each
with its ancestors. Features of ancestors and text feed a chain of two states, main
text or not, trained on labelled pages; the best chain is found by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm.layouts import labelled_pages
from filewright.llm.text import trimmed

TRAINING_PAGES = 400
TRAINING_SEED = 5
STEPS, RATE, RIDGE = 300, 0.1, 1e-3

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
SIGNS = re.compile("[>\"']")
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

# Elements of HTML, by how they bound text.
RAW = set("script style noscript template iframe svg annotation annotation-xml head title textarea select".split())
# Those whose text runs to the end of a page that does not end them, and what may be inside a head.
TO_THE_END = set("script style textarea title".split())
IN_HEAD = set("html head title base basefont bgsound link meta script style noscript noframes template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = set("ul ol dl table body html".split())
SEEN_TAGS = set(
    "nav header footer aside article main section form table ul ol li p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption "
    "td button label address dl body div a".split()
)
# What a name of a class or id says of an element.
HINTS = {
    "ad": r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo)(?:$|[-_ 0-9])",
    "menu": r"nav|menu|breadcrumb|pagination|toolbar|tabs",
    "side": r"side|widget|related|recommend|popular|trending|more-",
    "foot": r"foot|copyright|legal|credits",
    "head": r"site-head|masthead|top-?bar|logo|page-header",
    "comment": r"comment|disqus|discuss|reply|replies|respon",
    "notice": r"cookie|consent|notice|gdpr|alert|popup|modal|banner|newsletter|subscri|warning",
    "share": r"share|social|tags|follow",
    "main": r"content|article|post|entry|story|body|main|text",
}
HINT_PATTERNS = {name: re.compile(pattern, re.IGNORECASE) for name, pattern in HINTS.items()}


def _names(attributes: str) -> str:
    return " ".join("".join(found) for found in NAMES.findall(attributes)) if "=" in attributes else ""


class Tags:
    """The tags of a page from left to right. Where a search found nothing it is not made again, so all take time in proportion."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.ends = {quote: page.rfind(quote) for quote in "\"'"}
        self.unclosed: set[int] = set()  # quotes from which no tag ends

    def after(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name, whether it ends an element, attributes) of the next tag; comments and the like have no name."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                return start, self._to("-->", start), None, False, ""
            if page.startswith("<![CDATA[", start):
                return start, self._to("]]>", start), None, False, ""
            if start < self.last:
                if page.startswith(("<!", "<?"), start):
                    return start, page.find(">", start) + 1, None, False, ""
                found = NAME.match(page, start + 1, self.last)
                if found:
                    end = self._end(found.end())
                    return start, end, found.group(2).lower(), bool(found.group(1)), page[found.end() : end - 1]
                at = start + 1
            else:  # only a comment can begin here
                found = [place for place in (page.find(mark, start) for mark in ("<!--", "<![CDATA[")) if place >= 0]
                if not found:
                    return None
                at = min(found)

    def _to(self, mark: str, start: int) -> int:
        end = self.page.find(mark, start)
        return len(self.page) if end < 0 else end + len(mark)

    def _end(self, at: int) -> int:
        """Behind the ``>`` of a tag: the first outside quotes, or the first at all if a quote is not closed."""
        page, first, opened = self.page, at, []
        while True:
            found = SIGNS.search(page, at)
            if found is None:
                break
            if found.group() == ">":
                return found.end()
            opened.append(found.start())
            if found.start() in self.unclosed or found.start() == self.ends[found.group()]:
                break
            at = page.find(found.group(), found.end()) + 1
        self.unclosed.update(opened)
        return page.find(">", first) + 1


class Element:
    """An open element with what its ancestors and itself say of text in it."""

    __slots__ = ("tag", "links", "tags", "hints", "own", "article", "odd", "features")

    def __init__(self, above: Element | None, tag: str, names: str):
        self.tag = tag
        self.links = (above.links if above else 0) + (tag == "a")
        self.tags = above.tags if above else frozenset()
        self.hints = above.hints if above else frozenset()
        self.own = tag if tag in BLOCKS else above.own if above else None
        self.article = bool(above and above.article) or tag in ("article", "main")
        self.odd = bool(above and above.odd)
        self.features: frozenset | None = None
        if tag in SEEN_TAGS and tag not in self.tags:
            self.tags = self.tags | {tag}
        if names:
            hints = {hint for hint, pattern in HINT_PATTERNS.items() if pattern.search(names)}
            self.odd = self.odd or bool(hints - {"main"})
            if tag not in ("body", "html") and not hints <= self.hints:
                self.hints = self.hints | hints

    def above(self) -> frozenset:
        if self.features is None:
            found = {f"in:{tag}" for tag in self.tags} | {f"name:{hint}" for hint in self.hints}
            if self.own:
                found.add(f"own:{self.own}" if self.own in SEEN_TAGS else "own:other")
            if self.article and not self.odd:
                found.add("plain article")
            self.features = frozenset(found)
        return self.features


class Stack:
    """The open elements, with the places of each tag among them."""

    def __init__(self):
        self.elements: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> Element | None:
        return self.elements[-1] if self.elements else None

    def nearest(self, tags) -> int:
        """The place of the innermost element with one of the tags, -1 if there is none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def open(self, tag: str, names: str) -> None:
        self.places.setdefault(tag, []).append(len(self.elements))
        self.elements.append(Element(self.top(), tag, names))

    def shut(self, tags, stop=()) -> None:
        """End the innermost element with one of ``tags``, and all in it, unless one of ``stop`` is inside of it."""
        place = self.nearest(tags)
        if place > self.nearest(stop):
            while len(self.elements) > place:
                self.places[self.elements.pop().tag].pop()


OTHER_BLOCKS = BLOCKS - {"p"}


def blocks(page: str) -> list[tuple[str, frozenset, float]]:
    """(text, features of the ancestors, share of link text) of every leaf block, in page order; character references are decoded."""
    stack, tags = Stack(), Tags(page)
    made: list[tuple[str, frozenset, float]] = []
    pieces: list[str] = []
    linked = 0
    in_head = False
    unended: set[str] = set()

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            top = stack.top()
            made.append((text, top.above() if top else frozenset(), min(linked / len(text), 1.0)))
        pieces, linked = [], 0

    def text_to(end: int) -> None:
        nonlocal linked, in_head
        if end > at:
            piece = page[at:end]
            if in_head and not piece.strip():
                return
            in_head = False
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if stack.elements and stack.elements[-1].links:
                linked += len(piece.strip())

    at = 0
    while (found := tags.after(at)) is not None:
        start, end, name, ending, attributes = found
        text_to(start)
        at = end
        if name is None:
            continue
        if in_head:
            in_head = name not in ("head", "body", "html", "br") if ending else name in IN_HEAD
        if name in BLOCKS:
            flush()
        elif name == "br":
            pieces.append(" ")
        if ending:
            stack.shut((name,))
            continue
        if name in RAW:
            if attributes.endswith("/") or name in unended:
                continue
            if name == "head":
                in_head = True
                continue
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at, tags.last + 1)
            if stop or name in TO_THE_END:
                at = stop.end() if stop else len(page)
            else:
                unended.add(name)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS:
            stack.shut(("p",), OTHER_BLOCKS)
        if name in CLOSES:
            stack.shut(CLOSES[name], KEEPS_OPEN)
        stack.open(name, _names(attributes))
    text_to(len(page))
    flush()
    return made


def features(page: list[tuple[str, frozenset, float]]) -> list[list[str]]:
    made = []
    longest = max((len(text) for text, _, _ in page), default=1)
    for text, above, linked in page:
        found = ["bias", f"size:{min(len(text).bit_length(), 10)}", *above]
        if linked > 0.5:
            found.append("linked")
        if text[-1] in ".?!":
            found.append("ends")
        if "," in text:
            found.append("comma")
        if "©" in text or text[:9].lower() == "copyright":
            found.append("copyright")
        if len(text) * 2 >= longest:
            found.append("long here")
        made.append(found)
    return made


class Field:
    """A trained chain: weights of features for main text, and of steps between states."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps.tolist()

    def decode(self, page: list[list[str]]) -> list[bool]:
        """The best chain of states, by Viterbi; True is main text."""
        weights, ((s00, s01), (s10, s11)) = self.weights, self.steps
        other, main = 0.0, 0.0
        back: list[tuple[bool, bool]] = []
        for at, found in enumerate(page):
            score = sum(weights.get(f, 0.0) for f in found)
            if not at:
                main = score
                continue
            to_other, to_main = main + s10 > other + s00, main + s11 >= other + s01
            back.append((to_other, to_main))
            other, main = max(other + s00, main + s10), max(other + s01, main + s11) + score
        state = main >= other
        states = [state]
        for to_other, to_main in reversed(back):
            state = to_main if state else to_other
            states.append(state)
        return states[::-1][: len(page)]


def fit(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximise the likelihood of labelled pages, with a small penalty on large weights, by gradient steps (Adam)."""
    pages = [(found, labels) for found, labels in pages if found]
    names = sorted({f for found, _ in pages for block in found for f in block})
    index = {name: at for at, name in enumerate(names)}
    longest = max(len(found) for found, _ in pages)
    data = np.zeros((len(pages), longest, len(names)), np.float32)
    labels = np.zeros((len(pages), longest), int)
    mask = np.zeros((len(pages), longest), bool)
    for p, (found, known) in enumerate(pages):
        for t, block in enumerate(found):
            data[p, t, [index[f] for f in block]] = 1
        labels[p, : len(known)] = known
        mask[p, : len(known)] = True
    weights, steps = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    both = mask[:, 1:]
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((labels[:, :-1] == i) & (labels[:, 1:] == j) & both).sum()
    flat = data.reshape(-1, len(names))
    for step in range(1, STEPS + 1):
        scores = np.zeros((len(pages), longest, 2))
        scores[:, :, 1] = (flat @ weights.astype(np.float32)).reshape(len(pages), longest)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            ahead = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], ahead, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            behind = np.logaddexp.reduce(steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], behind, 0)
        chance = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0)) * mask
        slope = flat.T @ (labels * mask - chance).reshape(-1).astype(np.float32)
        joint = np.exp(
            forward[:, :-1, :, None] + steps + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        expected = (joint * both[:, :, None, None]).sum(axis=(0, 1))
        gradient = np.concatenate((slope, (seen - expected).ravel())) / len(pages) - RIDGE * np.concatenate((weights, steps.ravel()))
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, steps = weights + move[:-4], steps + move[-4:].reshape(2, 2)
    return Field({name: float(weights[at]) for name, at in index.items()}, steps)


def train(count: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Field:
    pages = []
    for page, known in labelled_pages(count, seed):
        read = blocks(page)
        if [text for text, _, _ in read] == [" ".join(text.split()) for text, _ in known]:
            pages.append((features(read), [label for _, label in known]))
    return fit(pages)


def main_text(page: str | None, field: Field) -> str:
    read = blocks(page or "")
    return "\n".join(text for (text, _, _), kept in zip(read, field.decode(features(read))) if kept)


def extract(pages: DataFrame, html_col: str = "html", field: Field | None = None) -> DataFrame:
    """``pages`` without their html, with ``text`` and ``n_chars``, its length in code points.

    NULL and empty pages, and pages without a block of main text, have an empty text. Markup that is
    cut off or wrongly nested is read as far as it goes. Repeated rows each get their result; an empty table
    gives none. The results take the place of other columns named text or n_chars, whatever their case.
    """
    chain = field or train()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = [main_text(page, chain) for page in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    [*part.schema.names[1:], "text", "n_chars"],
                )

    others = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.col(html_col), *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(trimmed(made), (schema + ", " if schema else "") + "text string, n_chars bigint")
