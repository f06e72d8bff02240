"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (runs of text that no block tag interrupts), in page order.  Each block has
features of its ancestors (tags, words of class, id and role) and of its text (length, share of linked text,
sentence ends, marks).  The field scores each block's label (article text or not) and each pair of
neighbours; ``train`` fits the weights by gradient steps on the log-likelihood of labelled pages (forward-backward),
``decode`` finds the best labels by Viterbi.

Labelled pages come from two places: pages of the table that mark their article with a tag (a bounded sample,
``MAX_PAGES``, by a hash of the page id; every fourth is used a second time without those tags, so that the other features
carry weight too), and the small labelled layouts in ``LAYOUTS``, which show menus, adverts, notices, forms and comments.

Scripts, styles, templates, frames, drawings, choices and comments never become blocks; one of them without an end tag hides the rest of the page
only where HTML reads it as raw text (``RAW``).  Formulas and objects are text like any other.  Character references are decoded, white space inside a block
becomes one space, empty blocks vanish; the blocks labelled as article are joined by one space.

Null or empty html, or no article block: empty text.  Pages are decoded one by one, so repeated rows and ties need no rule.  Without any
page the layouts alone train the field.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MAX_PAGES = 100
#: Blocks of one page used in training: a bounded cost for very long pages; decoding has no such bound.
MAX_BLOCKS = 200

HEAD = re.compile(r"<(?:(?P<comment>!--)|(?P<data>!\[CDATA\[)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*))")
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

#: How tags behave.
RAW = frozenset("script style iframe textarea title".split())  # to the end tag, or to the end of the page
SKIPPED = frozenset("template noscript svg select".split())  # to the matching end tag; without one only the start tag
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr input button object math maction menclose merror mfrac mi mmultiscripts "
                   "mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
                   "munder munderover none semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
#: Tags that hold no article text even inside an article.
ASIDE = frozenset("nav aside footer form button menu dialog".split())


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Tags that end the one before them.
FOLLOWING = frozenset("p li dt dd tr td th option".split())


class _TagEnds:
    """Where a tag ends: at the first ``>`` outside quotes.  Found for all places at once, from the page's end, so that tags
    without an end cost no more than others."""

    def __init__(self, page: str):
        self.places = [m.start() for m in re.finditer("[>\"']", page)]
        self.ends = [-1] * (len(self.places) + 1)
        after: dict[str, int] = {}  # the next quote of each kind
        for i in range(len(self.places) - 1, -1, -1):
            c = page[self.places[i]]
            if c == ">":
                self.ends[i] = self.places[i]
            else:
                self.ends[i] = self.ends[after[c] + 1] if c in after else -1
                after[c] = i

    def of(self, at: int) -> int:
        """End of a tag whose name ends at ``at``, or -1."""
        return self.ends[bisect_left(self.places, at)]


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, tag, whether it is an end tag, and attributes of everything that is not text, in time linear in the page.

    Comments and declarations have an empty tag.  The content of RAW elements belongs to their start tag."""
    ends, at, last = _TagEnds(page), 0, page.rfind(">")
    while m := HEAD.search(page, at):
        start, at = m.start(), m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            mark = "-->" if m["comment"] else "]]>" if m["data"] else ">"
            if m["other"] and last < at:
                continue  # no declaration without an end
            end = page.find(mark, at)
            at = len(page) if end < 0 else end + len(mark)
            yield start, at, "", False, ""
            continue
        end = ends.of(at)
        if end < 0:
            at = start + 1
            continue
        attrs, at = page[at:end], end + 1
        if tag in RAW and not m["end"] and not attrs.endswith("/"):
            close = _RAW_END[tag].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = len(page) if end < 0 else end + 1
        yield start, at, tag, bool(m["end"]), attrs


def skips(found: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """For each start tag of a SKIPPED element, by its place in the tokens, the place of its matching end tag."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in SKIPPED}
    for i, (_, _, tag, ends, attrs) in enumerate(found):
        if tag in SKIPPED:
            if not ends:
                if not attrs.endswith("/"):
                    opened[tag].append(i)
            elif opened[tag]:
                out[opened[tag].pop()] = i
    return out


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    parent: str
    names: frozenset[str]
    linked: float
    features: list[str] = field(default_factory=list)


class _Ancestors:
    """Open elements, with counts of their tags and names; only those in ``known`` are counted if it is given."""

    def __init__(self, known: tuple[frozenset[str], frozenset[str]] | None):
        self.known = known
        self.stack: list[tuple[str, list[str]]] = []
        self.places: dict[str, list[int]] = {}  # of each open tag
        self.outer: list[int] = []  # of the tags that are not inline
        self.tags: Counter = Counter()
        self.names: Counter = Counter()

    def push(self, tag: str, attrs: str) -> None:
        names = WORD.findall(" ".join("".join(v) for v in NAMED.findall(attrs)).lower()) if attrs else []
        if self.known:
            names = [n for n in names if n in self.known[1]]
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, names))
        if not self.known or tag in self.known[0]:
            self.tags[tag] += 1
        self.names.update(names)

    def cut(self, size: int) -> None:
        """Close all but the outermost ``size`` elements."""
        while len(self.stack) > size:
            tag, names = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.outer.pop()
            for counts, items in ((self.tags, [tag]), (self.names, names)):
                for x in items:
                    if counts[x] > 1:
                        counts[x] -= 1
                    else:
                        counts.pop(x, None)

    def close(self, tag: str) -> None:
        """An end tag; an inline one closes nothing outside its block."""
        open_at = self.places.get(tag)
        if open_at and (tag not in INLINE or not self.outer or open_at[-1] > self.outer[-1]):
            self.cut(open_at[-1])

    def follow(self, tag: str) -> None:
        """A new one ends the one before, if no other block lies between."""
        open_at = self.places.get(tag)
        if open_at and open_at[-1] == self.outer[-1]:
            self.cut(open_at[-1])


def blocks(page: str | None, known: tuple[frozenset[str], frozenset[str]] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; of their ancestors' tags and names only the ``known`` ones if that is given."""
    out: list[Block] = []
    above = _Ancestors(known)
    held: list[tuple[str, bool]] = []
    page = page or ""
    found = list(tokens(page))
    ends: dict[int, int] | None = None  # made when a page needs it

    def close() -> None:
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                linked = sum(len(t) for t, a in held if a) / max(1, sum(len(t) for t, _ in held))
                parent = above.stack[above.outer[-1]][0] if above.outer else ""
                out.append(Block(text, frozenset(above.tags), parent, frozenset(above.names), linked))
            held.clear()

    def add(text: str) -> None:
        if text:
            held.append((entities.unescape(text), bool(above.places.get("a"))))

    at = i = 0
    while i < len(found):
        start, end, tag, closing, attrs = found[i]
        add(page[at:start])
        at, i = end, i + 1
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if closing:
            above.close(tag)
        elif tag in SKIPPED and not attrs.endswith("/"):
            ends = skips(found) if ends is None else ends
            if i - 1 in ends:
                i = ends[i - 1]
                at, i = found[i][1], i + 1
        elif tag not in VOID and tag not in RAW and not attrs.endswith("/"):
            if tag in FOLLOWING:
                above.follow(tag)
            above.push(tag, attrs)
    add(page[at:])
    close()
    return out


def featurise(found: list[Block]) -> list[Block]:
    """Fill in the features of each block of one page."""
    for b in found:
        words = b.text.split()
        ends = sum(w[-1] in ".!?…" for w in words)
        b.features = [
            "bias", *[f"in:{t}" for t in sorted(b.tags)], *[f"name:{w}" for w in sorted(b.names)],
            f"parent:{b.parent}",
            f"words:{min(6, len(words).bit_length())}", f"linked:{min(3, int(b.linked * 4))}",
            f"ends:{min(3, ends)}",
            *(["rights"] if re.search(r"©|\(c\)|all rights|copyright", b.text, re.I) else []),
            *(["bars"] if b.text.count("|") + b.text.count("·") > 1 else []),
            *(["last:stop"] if b.text[-1] in ".!?…\"”»" else []),
        ]
    return found


@dataclass
class Field:
    """Weights of the label "article" for each feature, and of neighbouring labels."""

    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, found: list[Block]) -> list[bool]:
        """Best labels by Viterbi."""
        scores = [sum(self.weights.get(f, 0.0) for f in b.features) for b in found]
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        for i, s in enumerate(scores):
            if i == 0:
                zero, one = 0.0, s
                continue
            back.append((0 if zero + p00 >= one + p10 else 1, 0 if zero + p01 >= one + p11 else 1))
            zero, one = max(zero + p00, one + p10), max(zero + p01, one + p11) + s
        label = int(one > zero)
        out = [bool(label)] if found else []
        for step in reversed(back):
            label = step[label]
            out.append(bool(label))
        return out[::-1]

    def known(self) -> tuple[frozenset[str], frozenset[str]]:
        """Tags and names that have a weight; others change no score."""
        return tuple(frozenset(f[len(kind):] for f in self.weights if f.startswith(kind)) for kind in ("in:", "name:"))

    def text(self, page: str | None, known: tuple[frozenset[str], frozenset[str]] | None = None) -> str:
        found = featurise(blocks(page, known))
        return " ".join(b.text for b, keep in zip(found, self.decode(found)) if keep)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.4, ridge: float = 1e-3) -> Field:
    """Fit weights on pages of (features of each block, labels) by AdaGrad on the regularised log-likelihood."""
    names = {f: i for i, f in enumerate(sorted({f for blocks_, _ in pages for b in blocks_ for f in b}))}
    data = []
    for page, labels in pages:
        flat = np.array([names[f] for b in page for f in b], dtype=np.int64)
        starts = np.cumsum([0, *[len(b) for b in page]])[:-1]
        if len(page):
            data.append((flat, starts, np.array(labels)))
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    gw, gp = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        dw, dp = -ridge * w, -ridge * pairs
        for flat, starts, y in data:
            score = np.add.reduceat(w[flat], starts)
            p1, expected = _marginals(score, pairs)
            lengths = np.diff(np.append(starts, len(flat)))
            np.add.at(dw, flat, np.repeat((y - p1) / len(data), lengths))
            real = np.zeros((2, 2))
            np.add.at(real, (y[:-1], y[1:]), 1.0)
            dp += (real - expected) / len(data)
        gw += dw**2
        gp += dp**2
        w += rate * dw / np.sqrt(gw)
        pairs += rate * dp / np.sqrt(gp)
    return Field({f: float(w[i]) for f, i in names.items()}, pairs)


def _marginals(score: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each place, and expected counts of neighbouring labels, by forward-backward."""
    n = len(score)
    own = np.stack([np.zeros(n), score], axis=1)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = own[0]
    for i in range(1, n):
        fore[i] = own[i] + np.logaddexp(fore[i - 1, 0] + pairs[0], fore[i - 1, 1] + pairs[1])
    for i in range(n - 2, -1, -1):
        right = own[i + 1] + back[i + 1]
        back[i] = np.logaddexp(pairs[:, 0] + right[0], pairs[:, 1] + right[1])
    whole = np.logaddexp(fore[-1, 0], fore[-1, 1])
    p1 = np.exp(fore[:, 1] + back[:, 1] - whole)
    expected = np.exp(fore[:-1, :, None] + pairs + (own + back)[1:, None, :] - whole).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return p1, expected


#: Labelled layouts: wrappers (tag.name) of boilerplate and of article blocks, and texts to fill them with.
BOILERPLATE = """nav/ul/li/a header/div.logo header/h1.site-title header/nav/a div.menu/a div.nav/ul/li/a div.navbar/span div.header/p div.topbar/p
footer/p div.footer/p div.footer/a aside/p aside.sidebar/h3 aside/ul/li/a div.sidebar/p div.widget/ul/li/a div.ad/p div.ad div.ads/p
div.advert/p div.advertisement/span div.banner/p div.sponsored/p div.promo/p div.cookie-notice/p div.cookie-banner/p div.notice/p div.consent/p
div.newsletter/form/label form/label form/p form/button div.subscribe/p div.login/form/p div.search/form/p section.comments/h3 section.comments/p
div.comments/div.comment/p div.comment/p div.comment/span.author ol.commentlist/li/p div.reply/p article/section.comments/p
article/div.comments/div.comment/p article/aside/p article/div.share/a article/div.ad/p article/footer/p article/form/p article/nav/a main/section.comments/p main/div.comment/p
main/aside/p main/nav/a div.post/div.comments/p div.content/div.comment/p div.content/div.ad/p div.post/div.share/a div.share/a div.social/a div.related/h3
div.related/ul/li/a div.breadcrumb/a div.pagination/a div.tags/a div.author-box/p div.copyright/p div.modal/p div.popup/p table.menu/tr/td/a""".split()
CONTENT = """article/h1 article/p article/h2 article/p/b article/ul/li article/blockquote/p article/pre article/table/tr/td main/h1 main/p main/article/p
div.content/h1 div.content/p div.article/p div.article-body/p div.post/h2 div.post/p div.entry-content/p div.entry/p div.story/p div.text/p div.main/p
section.content/p section/h2 section/p div/h1 div/p body/h1 body/p article/div/p article/section/p p h1 h2 main/div/p main/ul/li article/figure/figcaption""".split()
SENTENCES = (
    "The committee met on Tuesday and agreed to publish the report before the end of the year.",
    "Nobody had expected the river to rise so fast. By noon the lower streets were under water, and the bridge was closed.",
    "Short answer.", "A second look", "Why it matters: costs fall when the work is shared, and they keep falling.",
    "In the first part we measured the time that each step takes; the second part compares three ways to shorten it. The results differ.",
)
SNIPPETS = (
    "Home", "About us", "Contact", "Sign in", "Read more", "Share", "Log in to reply", "© 2020 All rights reserved", "Privacy · Terms · Imprint",
    "Buy one now and save half of the price. Offer ends soon.", "We use cookies to make this site work. Accept all?", "Your email address",
    "Great post, thanks for writing this. I disagree with the second part though.", "Leave a comment", "Related stories", "Subscribe",
)


def layout_pages(n: int = 240, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages made of the layouts: boilerplate, an article, boilerplate."""
    rng = random.Random(seed)

    def wrapped(path: str, text: str) -> str:
        parts = [p.partition(".") for p in path.split("/")]
        head = "".join(f'<{t} class="{c}">' if c else f"<{t}>" for t, _, c in parts)
        return head + text + "".join(f"</{t}>" for t, _, _ in reversed(parts))

    out = []
    for _ in range(n):
        plan = [(rng.choice(BOILERPLATE), 0) for _ in range(rng.randint(0, 5))]
        kind = rng.choice(["article", "article", "main", "div", "section", "body", "p"])
        own = [c for c in CONTENT if (c.startswith(kind) if kind != "p" else c in ("p", "h1", "h2"))]
        for _ in range(rng.randint(1, 8)):
            plan.append((rng.choice(own), 1))
            if rng.random() < 0.15:
                plan.append((rng.choice([b for b in BOILERPLATE if b.startswith(("article/", "main/", "div.post/", "div.content/"))]), 0))
        plan += [(rng.choice(BOILERPLATE), 0) for _ in range(rng.randint(0, 6))]
        rows, labels = [], []
        for path, label in plan:
            text = rng.choice(SENTENCES if rng.random() < (0.8 if label else 0.3) else SNIPPETS)
            rows += blocks(wrapped(path, text))
            labels.append(label)
        out.append(([b.features for b in featurise(rows)], labels))
    return out


def marked_page(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page that marks its article with a tag, else nothing."""
    found = featurise(blocks(page))[:MAX_BLOCKS]
    labels = [int(bool(ARTICLE & b.tags) and not ASIDE & b.tags) for b in found]
    return (found, labels) if 0 < sum(labels) else None


def trained(pages: DataFrame, html: str = "html", id_col: str = "page_id", most: int = MAX_PAGES) -> Field:
    """A field trained on the layouts and a bounded sample of pages."""
    sample = pages.where(F.col(html).contains("<article") | F.col(html).contains("<main")).select(
        F.col(id_col).alias("_id"), F.col(html).alias("_html")).orderBy(F.xxhash64("_id"), "_id").limit(most)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, page in rows:
            marked = marked_page(page)
            if marked:
                yield [b.features for b in marked[0]], marked[1]

    rows = map_rows(sample, run, "features array<array<string>>, labels array<int>").collect()  # at most ``most`` pages of MAX_BLOCKS blocks
    data = layout_pages()
    for k, r in enumerate(rows):
        data.append((r["features"], r["labels"]))
        if k % 4 == 0:
            data.append(([[f for f in b if f not in ("in:article", "in:main", "parent:article", "parent:main")] for b in r["features"]], r["labels"]))
    return train(data)


def extract(pages: DataFrame, model: Field, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url and text of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        model = held.value
        known = model.known()
        for page_id, link, page in rows:
            yield page_id, link, model.text(page, known)

    return map_rows(pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html")), run,
                    "page_id long, url string, text string", lambda r: 100 + len(r[2]))
