"""HTML extraction (8): the maximum-scoring contiguous region of a page, words positive and tags negative.

A page is a sequence of words and tags in page order. A word's score is the log-odds that it belongs to the article,
learnt for the elements that it stands in from labelled pages; a tag costs what tags cost there. One linear scan finds
the contiguous stretch with the greatest sum. The region's blocks are returned, without those words inside it that
stand in elements which never hold article text (scripts, forms), which count nothing, or whose own score is negative
(an advert or a comment in the middle of an article).

The labelled pages are made here by a fixed rule, as none are given: they mark up an article, in a box of its own or
straight in the body, and what surrounds it in the ways of common page templates, and each piece of text is labelled as
article or not. Tags are read in one pass whose work is linear in the page, whatever its quotes and nesting.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm._common import map_arrow

LABELLED_PAGES, LABEL_SEED = 400, 11
#: A word's least score: what lies inside an article shouldn't cut off the article's end, as it is left out anyway.
LEAST, MOST = -0.1, 2.0
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements within a line of text, which say nothing about where it stands.
INLINE = frozenset(["", "html", "body", *"a abbr b big cite code em font i mark q s small span strong sub sup time tt u".split()])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "button", "canvas", "math", "audio", "video")
DROPPED = frozenset([*RAW, "form", "head", "title", "nav", "menu", "footer", "header", "aside", "dialog", "fieldset", "label"])
#: Elements whose start ends an open p, and those that end an open element of their own kind.
ENDS_P = BLOCKS - frozenset("body dd dt head html li option tbody td tfoot th thead title tr".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}


#: Names of which an open element may be ended by a start tag, and those beyond which it can't be seen.
ENDABLE = frozenset().union(*ENDS_OWN.values())
SCOPE = frozenset("ul ol dl table div article section select button body".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")


class Element:
    __slots__ = ("name", "marks", "parent", "own", "value", "dropped", "near")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent = name, parent
        found = "".join(" " + (a or b or c) for a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
        self.marks = frozenset(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found).lower()))
        self.own = frozenset({name, *(f".{m}" for m in self.marks)}) - INLINE
        self.value, self.dropped = None, bool(self.own & DROPPED) or (parent is not None and parent.dropped)
        # The nearest open element of each endable name, seen from here.
        near = parent.near if parent is not None and name not in SCOPE else {}
        self.near = near | {name: self} if name in ENDABLE else near

    def path(self) -> frozenset[str]:
        """The names and marks of the element and all around it."""
        out, up = set(), self
        while up is not None:
            out |= up.own
            up = up.parent
        return frozenset(out)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, lower-case name or "" for comments and the like, attributes) of the tags in order.

    A page's rest may be sent by send(position): the next tag is looked for from there.
    """
    at, n, gone = 0, len(page), {}
    while (low := page.find("<", at)) >= 0:
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            high, out = (end + 3 if end >= 0 else n), (False, "", "")
        elif page[low + 1 : low + 2] in ("!", "?"):
            end = page.find(">", low)
            high, out = (end + 1 if end >= 0 else n), (False, "", "")
        else:
            closing = page.startswith("/", low + 1)
            m = NAME.match(page, low + 1 + closing)
            if not m:
                at = low + 1
                continue
            here = m.end()
            # To the first > outside of quotes; a quote without its end is a sign like others, and stays so to the end.
            while here < n and (stop := END_OR_QUOTE.search(page, here)):
                here = stop.end()
                sign = stop[0]
                if sign == ">":
                    break
                end = -1 if sign in gone else page.find(sign, here)
                if end < 0:
                    gone[sign] = True
                else:
                    here = end + 1
            else:
                here = n
            closed = here <= n and page[here - 1] == ">"
            high, out = here, (closing, m[0].lower(), page[m.end() : here - closed])
        jump = yield (low, high, *out)
        at = max(high, jump or 0)


END_OR_QUOTE = re.compile("[>\"']")


def pieces(page: str) -> list[tuple[str, Element | None, int]]:
    """(text, its element, number of its block) for text, ("", element, block) for each tag, in page order."""
    out: list[tuple[str, Element | None, int]] = []
    here, block, at, n = Element("", "", None), 0, 0, len(page)
    count: dict[str, int] = defaultdict(int)
    found, jump = tags(page), None

    def leave(up: Element) -> Element:
        """Out of the element and all within it."""
        now = here
        while True:
            count[now.name] -= 1
            if now is up:
                return now.parent
            now = now.parent

    while True:
        try:
            low, high, closing, name, attributes = found.send(jump)
        except StopIteration:
            break
        jump = None
        if low > at:
            out.append((page[at:low], here, block))
        at = high
        if not name:
            continue
        if closing:
            if count[name]:  # an end tag without a start is left out
                up = here
                while up.name != name:
                    up = up.parent
                here = leave(up)
        else:
            if name in ENDS_P and "p" in here.near:
                here = leave(here.near["p"])
            open_ones = [here.near[x] for x in ENDS_OWN.get(name, ()) if x in here.near]
            if open_ones:
                inner = set(map(id, open_ones))
                up = here
                while id(up) not in inner:
                    up = up.parent
                here = leave(up)
            if name in CLOSERS:
                inside = Element(name, attributes, here)
                end = CLOSERS[name].search(page, at)
                out.append((page[at : end.start() if end else n], inside, block + 1))
                at = jump = end.end() if end else n
            elif name not in VOID and not attributes.endswith("/"):
                here = Element(name, attributes, here)
                count[name] += 1
        if name in BLOCKS:
            block += 1
        elif name == "br":
            out.append((" ", here, block))
        out.append(("", here, block))
    if at < n:
        out.append((page[at:], here, block))
    return out


def _template(rng: random.Random) -> list[tuple[str, bool]]:
    """A labelled page as a list of markup and text; text that begins with + is article, with - is not."""
    word = lambda: "".join(rng.choice("abdefgiklmnoprstuv") for _ in range(rng.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    bad = lambda a, b: "-" + words(a, b)
    links = lambda tag, n: "".join(f"<{tag}><a href='/x'>" + "\0" + bad(1, 2) + "\0" + f"</a></{tag}>" for _ in range(n))

    def box(tag: str, kinds: str, a: int, b: int, inner: str = "p") -> str:
        kind = rng.choice(kinds.split())
        body = "".join(f"<{inner}>\0" + bad(a, b) + f"\0</{inner}>" for _ in range(rng.randint(1, 3)))
        return f'<{tag} class="{kind}">{body}</{tag}>'

    around = [
        lambda: "<nav><ul>" + links("li", rng.randint(3, 8)) + "</ul></nav>",
        lambda: f'<div class="{rng.choice("menu navbar navigation breadcrumb breadcrumbs topbar".split())}">' + links("span", 4) + "</div>",
        lambda: box("header", "header masthead site", 1, 6, "div"),
        lambda: box("aside", "sidebar aside related widget", 3, 25),
        lambda: box("div", "ad ads advert advertisement sponsored promo banner", 2, 25),
        lambda: box("div", "cookie notice consent gdpr alert banner popup modal newsletter subscribe", 5, 30),
        lambda: box("div", "sidebar related recommended widget share social tags", 2, 20),
        lambda: "<form><label>\0" + bad(1, 3) + "\0</label><input name=q></form>",
        lambda: "<script>\0-var x\0</script>",
    ]
    after = [
        lambda: box("footer", "footer site copyright", 3, 20),
        lambda: box("div", "footer copyright legal", 3, 20),
        lambda: box("section", "comments comment discussion replies", 5, 60),
        lambda: box("div", "comments comment respond", 5, 60),
    ]
    good = lambda a, b: "\0+" + words(a, b) + "\0"
    body = f"<h1>{good(3, 9)}</h1>"
    for _ in range(rng.randint(1, 10)):
        roll = rng.random()
        if roll < 0.6:
            link = f"<a href='/y'>{good(1, 3)}</a>{good(2, 20)}" if rng.random() < 0.2 else ""
            body += rng.choice(["<p>{}</p>"] * 4 + ["<div><p>{}</p></div>", "<section><p>{}</p></section>", "<div>{}</div>"]).format(good(5, 90) + link)
        elif roll < 0.66:
            body += f"<h2>{good(1, 6)}</h2>"
        elif roll < 0.72:
            body += "<ul>" + "".join(f"<li>{good(2, 12)}</li>" for _ in range(3)) + "</ul>"
        elif roll < 0.76:
            body += f"<blockquote>{good(5, 30)}</blockquote>"
        else:
            body += rng.choice(around)()
    if rng.random() < 0.4:
        at = body.rfind("<p>") if rng.random() < 0.5 else len(body)
        body = body[:at] + rng.choice(after[2:])() + body[at:]
    wrap = rng.choice([None, None, "article", "article", "article", "main", 'div class="content"', 'div class="post entry"', 'div class="article body"', 'section class="story"'])
    page = "<html><head><title>\0" + bad(3, 9) + "\0</title></head><body>" + "".join(rng.choice(around)() for _ in range(rng.randint(1, 4)))
    if rng.random() < 0.4:
        body = f'<div class="{rng.choice("text inner row col wrapper".split())}">{body}</div>'
    page += (f"<{wrap}>{body}</{wrap.split()[0]}>" if wrap else body) + "".join(rng.choice(around + after)() for _ in range(rng.randint(0, 2))) + rng.choice(after)()
    if rng.random() < 0.4:
        kind = rng.choice("container wrapper page row site main".split())
        page = page.replace("<body>", f'<body><div class="{kind}">') + "</div>"
    page += "</body></html>"
    return [(x, k % 2 == 1) for k, x in enumerate(page.split("\0"))]


@functools.lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], float, float]:
    """(score of each element name and .mark, score of a word in none, score of a tag) from the labelled pages.

    A logistic regression of a word's label on the names and marks of the elements around it. A tag costs the share of
    other words among those next to tags, in the scale of a word's score.
    """
    rng = random.Random(LABEL_SEED)
    rows: dict[tuple[frozenset[str], bool], int] = defaultdict(int)
    near = [1, 1]
    for _ in range(LABELLED_PAGES):
        parts = _template(rng)
        marked = "".join(x if not is_text else ("\1" if x[0] == "+" else "\2") + x[1:] for x, is_text in parts)
        for text, element, _ in pieces(marked):
            if text[:1] in "\1\2" and text:
                good = text[0] == "\1"
                rows[element.path(), good] += len(text.split())
                near[good] += 1
    names = sorted(set().union(*(p for p, _ in rows)))
    index = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    y, n = np.zeros(len(rows)), np.zeros(len(rows))
    for k, ((path, good), count) in enumerate(sorted(rows.items(), key=lambda r: (sorted(r[0][0]), r[0][1]))):
        x[k, [index[f] for f in path]], x[k, -1], y[k], n[k] = 1, 1, good, count
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-4 * w), -2, 2)
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]), -abs(math.log(near[0] / near[1])) / 4 - 0.1


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous stretch with the greatest sum, found in one scan; (0, 0) if no sum is above zero."""
    best = total = 0.0
    low = high = start = 0
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, low, high = total, start, k + 1
    return low, high


class Extractor:
    def __init__(self):
        self.weight, self.base, self.tag = weights()

    def score(self, element: Element) -> float:
        """Of a word in the element: above zero where it is rather article text.

        Evidence is added up from the outermost element inwards and never stands above MOST, so an advert or a comment
        within an article is told by its own box, however strong the signs around the article are.
        """
        self._running(element)
        return 0.0 if element.dropped else max(min(element.value, MOST), LEAST)

    def _running(self, element: Element) -> float:
        if element.value is None:
            chain = []
            up = element
            while up is not None and up.value is None:
                chain.append(up)
                up = up.parent
            for e in reversed(chain):
                before = self.base if e.parent is None else min(e.parent.value, MOST)
                e.value = before + sum(self.weight.get(f, 0.0) for f in e.own)
        return min(element.value, MOST)

    def text(self, page: str) -> str:
        """The main text; an empty string where no word scores above zero."""
        parts = pieces(page)
        low, high = best_stretch([self.score(element) * len(text.split()) if text else self.tag for text, element, _ in parts])
        if low == high:
            return ""
        # A block that the region cuts belongs to it whole.
        inside = {block for _, _, block in parts[low:high]}
        while low and parts[low - 1][2] in inside:
            low -= 1
        while high < len(parts) and parts[high][2] in inside:
            high += 1
        blocks: dict[int, list[str]] = {}
        for text, element, block in parts[low:high]:
            if text and self.score(element) > 0:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks.values())
        return "\n".join(x for x in lines if x)


@functools.lru_cache(maxsize=1)
def extractor() -> Extractor:
    """One for all tasks of a worker process."""
    return Extractor()


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points).

    A null or empty page, or one without article text, has the empty string. Every page is read whole, in time linear in
    its length; unclosed, cut off and misplaced tags are taken as browsers do, roughly. Repeated rows stay, null keys and
    urls too; other columns are not read, so their names can't clash; an empty table gives no rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def make():
        own = extractor()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [own.text(x) if x else "" for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["k", "u", "text", "n_chars"])

        return run

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(source).alias("h"))
    return map_arrow(rows, make, f"k {kinds[key]}, u {kinds[url]}, text string, n_chars long").select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
