"""Main text of web pages by a graphical model on the document tree.

A page becomes a tree of its block elements with its runs of text, below which stand the inline elements of the run. Each
node has a hidden label, content or not. Unary potentials come from the tag, the words of class, id and role, and the
amount and linking of text; pairwise potentials connect each child with its parent, by the kind of child. Sum-product messages go up and then down the tree, so
every run gets its exact marginal. Weights are fitted by the likelihood of labelled pages, with expected counts from the
same messages. The pages table has no labels, so the labelled pages are made here: varied layouts in which each part's
role is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.common import bounded_batches

#: Fixed values of the HTML standard: elements without content, elements whose content is no text of the page (scripts,
#: styles, form controls, titles and what is inert), inline elements, and those that hold a language of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noframes noembed xmp".split())
#: Of these, without an end tag, all that follows is a language of its own and no text.
CODE = frozenset(["script", "style"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input picture source svg math canvas audio video object".split())
FOREIGN = frozenset(["svg", "math"])
#: An opening tag on the left closes an open element on the right.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "tr", "td", "th"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "tbody": frozenset(["tr", "td", "th", "thead"]), "option": frozenset(["option"])}
#: An open element isn't closed through these.
WALLS = frozenset("table td th ul ol dl article section main body html div aside nav".split())
#: What a "<" can begin: a name after it, or after "</"; anything else is a comment or text. And what matters inside a tag.
TAG_NAME, IN_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)"), re.compile(r"[>\"']")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in sorted(RAW)}
#: Numeric character references of more digits than a code point has.
LONG_REFERENCE = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*));?")
ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAMES = re.compile(r"[a-z]{2,}")


class Page:
    """Parallel lists over the nodes, parents before children; runs have texts, elements have None. Of an inline element,
    linked holds the characters inside it."""

    def __init__(self) -> None:
        self.tags, self.parents, self.names, self.texts, self.linked, self.inline = ["#root"], [-1], [()], [None], [0], [False]

    def add(self, tag: str, parent: int, names: tuple, text: str | None = None, linked: int = 0, inline: bool = False) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.texts.append(text)
        self.linked.append(linked)
        self.inline.append(inline)
        return len(self.tags) - 1


class _Open:
    """The open elements, with counts that tell in one step whether a tag can be closed."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.count: dict[str, int] = defaultdict(int)
        self.scopes: list[dict[str, int]] = [defaultdict(int)]  # tags since each wall, that wall among them

    def push(self, node: int, tag: str) -> None:
        if tag in WALLS:
            self.scopes.append(defaultdict(int))
        self.nodes.append(node)
        self.tags.append(tag)
        self.count[tag] += 1
        self.scopes[-1][tag] += 1

    def pop(self) -> str:
        self.nodes.pop()
        tag = self.tags.pop()
        self.count[tag] -= 1
        self.scopes[-1][tag] -= 1
        if tag in WALLS:
            self.scopes.pop()
        return tag

    def close(self, tag: str) -> None:
        """An end tag: all up to the innermost such element, through whatever stands between."""
        while self.pop() != tag:
            pass

    def close_for(self, opening: str) -> None:
        """What an opening tag closes, as far as no wall stands between."""
        closing = CLOSES.get(opening, ())
        while any(self.scopes[-1][t] for t in closing):
            while self.pop() not in closing:
                pass


class Scanner:
    """The tags of a source, one after the other. Each call goes on where the last one ended and nothing is read twice: what
    the rest of the source lacks (a quote, an end tag) is looked for once."""

    def __init__(self, source: str) -> None:
        self.source, self.at, self.n = source, 0, len(source)
        self.last = {q: source.rfind(q) for q in "\"'"}  # a quote there opens nothing
        self.unended: set[str] = set()

    def _end_of_tag(self, at: int) -> int:
        """The place of the ">" that ends a tag, past quoted values; the source's end if there is none."""
        while (m := IN_TAG.search(self.source, at)) is not None:
            q = m[0]
            if q == ">":
                return m.start()
            at = m.end() if m.start() == self.last[q] else self.source.index(q, m.end()) + 1
        return self.n

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """Text up to a tag, the tag's name, whether it ends an element, and its attributes; comments have no name."""
        source = self.source
        while self.at < self.n:
            start = at = self.at
            while (at := source.find("<", at)) >= 0 and (at + 1 >= self.n or not (source[at + 1].isascii() and source[at + 1].isalpha()) and source[at + 1] not in "/!?"):
                at += 1  # a "<" that begins nothing is text
            if at < 0:
                self.at = self.n
                yield source[start:], "", False, ""
                return
            m = TAG_NAME.match(source, at + 1)
            if m:
                end = self._end_of_tag(m.end())
                self.at = end + 1
                # A tag that never ends is none, and neither is what it holds.
                yield source[start:at], m[1].lower() if end < self.n else "", source[at + 1] == "/", source[m.end() : end]
            else:
                comment = source.startswith("!--", at + 1)
                end = source.find("-->" if comment else ">", at + (2 if comment else 1))
                self.at = end + (3 if comment else 1) if end >= 0 else self.n
                yield source[start:at], "", False, ""

    def skip_raw(self, tag: str) -> None:
        """Past the end tag of an element whose content is no text; where there is none, code goes on to the end, and any other
        element is taken for empty."""
        m = None if tag in self.unended else RAW_END[tag].search(self.source, self.at)
        if m is not None:
            self.at = self._end_of_tag(m.end()) + 1
        elif tag in CODE:
            self.at = self.n
        else:
            self.unended.add(tag)


def plain_text(pieces: list[str]) -> str:
    """The pieces with references decoded and white space, no-break spaces included, as single spaces."""

    def short(m: re.Match) -> str:
        digits = m[1] or m[2] or ""
        return m[0] if len(m[0]) < 16 else f"&#{'x' if m[1] else ''}{digits};" if 0 < len(digits) < 9 else "\ufffd"

    text = "".join(pieces)
    return " ".join(html.unescape(LONG_REFERENCE.sub(short, text) if "&#" in text else text).split())


def parse(source: str) -> Page:
    """A tree of any text, however broken, in time proportional to its length; what no element closes ends with the page."""
    page, held = Page(), _Open()
    run: list[str] = []
    inside: list[list] = []  # inline elements of the run: tag, names, the one around, characters
    around: list[int] = []  # those that are open, as places in `inside`
    links = linked = foreign = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = plain_text(run)
            run.clear()
            if text:
                top = page.add("#text", held.nodes[-1], (), text, linked)
                first = len(page.tags)
                for tag, names, parent, size in inside:
                    page.add(tag, top if parent < 0 else first + parent, names, None, size, True)
            linked = 0
        inside.clear()
        around.clear()

    def names_of(attributes: str) -> tuple:
        return tuple(sorted({w for a in ATTRS.finditer(attributes) for w in NAMES.findall((a[1] or a[2] or a[3] or "").lower())})) if attributes else ()

    scanner = Scanner(source)
    for chunk, tag, ends, attributes in scanner:
        if chunk:
            run.append(chunk)
            if links:
                linked += len(chunk)
            if around:
                inside[around[-1]][3] += len(chunk)
        if not tag:
            continue
        if not ends:
            empty = tag in VOID or attributes.endswith("/")
            if tag in CLOSES:
                foreign = 0
            if tag in RAW and not attributes.endswith("/"):
                scanner.skip_raw(tag)
                run.append(" ")
            elif foreign or tag in INLINE:
                if tag in FOREIGN and not empty:
                    foreign += 1
                if tag == "a":
                    links += 1
                elif tag in VOID:
                    run.append(" ")
                if not empty:
                    inside.append([tag, names_of(attributes), around[-1] if around else -1, 0])
                    around.append(len(inside) - 1)
            else:
                flush()
                links = 0
                held.close_for(tag)
                node = page.add(tag, held.nodes[-1], names_of(attributes))
                if not empty:
                    held.push(node, tag)
        elif foreign or tag in INLINE:
            links = max(0, links - 1) if tag == "a" else links
            foreign = max(0, foreign - 1) if tag in FOREIGN else foreign
            if around and inside[around[-1]][0] == tag:
                around.pop()
        elif held.count.get(tag):
            flush()
            links = 0
            held.close(tag)
    flush()
    return page


KINDS = {t: k for k, ts in enumerate(["#text", "p blockquote pre dd dt figcaption td th", "h1 h2 h3 h4 h5 h6", "ul ol li dl menu", "table tbody thead tr", "nav header footer aside form fieldset button dialog address"]) for t in ts.split()}
#: A word of class, id or role is known if it stands in so many labelled pages; a page's other words only count as strange.
COMMON = 5
KINDS |= dict.fromkeys(sorted(INLINE - VOID), 6)
OTHER = 7


def size_step(n: int) -> int:
    return min(7, int(math.log2(n + 1) / 1.5))


def features(page: Page, known: frozenset[str] | None = None) -> list[list[str]]:
    """Names of the unary features of each node. known: the words of class, id and role that count, all by default; a model
    knows a fixed number of them, however many a page holds."""
    n = len(page.tags)
    names = page.names if known is None else [tuple(w for w in ws if w in known) for ws in page.names]
    total, link, kids = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.texts[i] is not None:
            total[i], link[i] = len(page.texts[i]), min(page.linked[i], len(page.texts[i]))
        kids[page.parents[i]] += not page.inline[i]
        total[page.parents[i]] += total[i]
        link[page.parents[i]] += link[i]
    out = []
    bare = [("" if own else "strange " if ws else "bare ") + t for ws, own, t in zip(page.names, names, page.tags, strict=True)]
    for i in range(n):
        share = (4 * link[i]) // max(1, total[i])
        if page.texts[i] is not None:
            t, up = page.texts[i], page.parents[i]
            stops = t.count(". ") + t.count(", ") + (t[-1] in ".!?")
            out.append([f"in:{page.tags[up]}", f"text:{size_step(len(t))}", f"links:{share}", f"stops:{min(stops, 3)}", f"prose:{size_step(len(t))} {min(stops, 3)} {share}", f"beyond:{bare[max(0, page.parents[up])]}", f"around:{size_step(kids[page.parents[up]])}", f"within:{bare[up]}", *(f"own:{w}" for w in names[up])])
        elif page.inline[i]:
            # Its kind alone tells little: bold words are content and names of commenters alike.
            out.append([f"inner:{w}" for w in names[i]])
        else:
            out.append([f"tag:{page.tags[i]}", f"sum:{size_step(total[i])}", f"share:{share}", f"among:{size_step(kids[page.parents[i]])}", f"kids:{size_step(kids[i])}", f"is:{bare[i]}", f"under:{bare[page.parents[i]]}", *(f"name:{w}" for w in names[i]), *(f"both:{page.tags[i]} {w}" for w in names[i])])
    return out


class TreeModel:
    """Weights of unary features, in favour of content, and of pairs of labels for each kind of child."""

    def __init__(self) -> None:
        self.unary: dict[str, float] = {}
        self.pair = [[0.0] * 4 for _ in range(OTHER + 1)]  # parent's label times 2 plus child's
        self.known: frozenset[str] = frozenset()

    def marginals(self, page: Page, named: list[list[str]]) -> tuple[list[float], list[float]]:
        """The probability that each node is content, and the one that it and its parent both are."""
        n, get, exp, log1p = len(page.tags), self.unary.get, math.exp, math.log1p

        def soft(x: float, y: float) -> float:
            return max(x, y) + log1p(exp(-abs(x - y)))

        own = [sum(get(f, 0.0) for f in fs) for fs in named]  # log odds of all below and at a node
        up = [0.0] * n
        pairs = [self.pair[KINDS.get(t, OTHER)] for t in page.tags]
        for i in range(n - 1, 0, -1):
            w = pairs[i]
            up[i] = soft(w[2], w[3] + own[i]) - soft(w[0], w[1] + own[i])
            own[page.parents[i]] += up[i]
        both, whole = [0.0] * n, own[:]
        for i in range(1, n):
            w, rest = pairs[i], whole[page.parents[i]] - up[i]
            down = soft(w[1], w[3] + rest) - soft(w[0], w[2] + rest)
            whole[i] = own[i] + down
            cells = (w[0], w[1] + own[i], w[2] + rest, w[3] + rest + own[i])
            top = max(cells)
            weights = [exp(c - top) for c in cells]
            both[i] = weights[3] / sum(weights)
        return [1 / (1 + exp(-max(-30.0, min(30.0, z)))) for z in whole], both

    def fit(self, pages: list[tuple[Page, list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 2e-5, seed: int = 5) -> TreeModel:
        """Adaptive gradient ascent on the likelihood of the labels: counts in the labels less expected counts."""
        seen = Counter(w for p, _ in pages for w in {w for ws in p.names for w in ws})
        self.known = frozenset(w for w, n in seen.items() if n >= COMMON)
        rng, named = random.Random(seed), [features(p, self.known) for p, _ in pages]
        squares: dict[str, float] = defaultdict(lambda: 1e-2)
        pair_squares = [[1e-2] * 4 for _ in self.pair]
        order = list(range(len(pages)))
        sums, pair_sums, taken = defaultdict(float), [[0.0] * 4 for _ in self.pair], 0  # the fit is the mean over the later half
        for epoch in range(epochs):
            rng.shuffle(order)
            for step, at in enumerate(order):
                if 2 * epoch >= epochs and step % 50 == 0:
                    taken += 1
                    for f, w in self.unary.items():
                        sums[f] += w
                    for ws, own in zip(pair_sums, self.pair, strict=True):
                        for c, w in enumerate(own):
                            ws[c] += w
                page, labels = pages[at]
                p, both = self.marginals(page, named[at])
                grads: dict[str, float] = defaultdict(float)
                pair_grads = [[0.0] * 4 for _ in self.pair]
                for i, fs in enumerate(named[at]):
                    for f in fs:
                        grads[f] += labels[i] - p[i]
                    if i:
                        up, g = page.parents[i], pair_grads[KINDS.get(page.tags[i], OTHER)]
                        expected = (1 - p[i] - p[up] + both[i], p[i] - both[i], p[up] - both[i], both[i])
                        for c in range(4):
                            g[c] += (2 * labels[up] + labels[i] == c) - expected[c]
                for f, g in grads.items():
                    g -= decay * self.unary.get(f, 0.0) * len(labels)
                    squares[f] += g * g
                    self.unary[f] = self.unary.get(f, 0.0) + rate * g / math.sqrt(squares[f])
                for w, gs, ss in zip(self.pair, pair_grads, pair_squares, strict=True):
                    for c, g in enumerate(gs):
                        g -= decay * w[c] * len(labels)
                        ss[c] += g * g
                        w[c] += rate * g / math.sqrt(ss[c])
        if taken:
            self.unary = {f: w / taken for f, w in sums.items()}
            self.pair = [[w / taken for w in ws] for ws in pair_sums]
        return self

    def extract(self, source: str) -> str:
        page = parse(source)
        p, _ = self.marginals(page, features(page, self.known))
        return "\n\n".join(t for t, q in zip(page.texts, p, strict=True) if t is not None and q >= 0.5)


# labelled pages

#: Class words that content may bear beside its own, as pages say what stands elsewhere, and that junk may bear.
MISLEADING = "comments-open comments-closed with-comments has-sidebar no-sidebar with-ads ads-loaded menu-open nav-fixed header-small sticky-footer share-on related-posts-on form-ready banner-top notice-read promo".split()
FLATTERING = "main content text body post article-extra inner-content story-end".split()
SYLLABLES = "an ta re ou ing ba sol ver mi ken la dor es tion ul".split()


class Maker:
    """Pages of random layouts; content carries a mark in its text by which labels are found after parsing."""

    MARK = "§"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.stops = 0.15  # how often a word ends with a stop
        self.terse = 0.25  # how often a block of prose is a few words

    def words(self, few: int, many: int) -> str:
        r = self.r
        ws = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) + (r.choice(",.!") if r.random() < self.stops else "") for _ in range(r.randint(few, many))]
        return " ".join(ws)

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def some(self, chance: float, make) -> str:
        return make() if self.r.random() < chance else ""

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{self.words(1, 4)}</a></{tag}>' for k in range(self.r.randint(2, 8)))

    def prose(self) -> str:
        r = self.r
        short = r.random() < self.terse
        text = self.MARK + self.words(*((1, 6) if short else (6, r.choice((20, 30, 60, 90, 90, 800)))))
        if self.r.random() < 0.2:
            t = self.pick("a", "a", "em", "b", "code", "span", "svg")
            text += f' <{t}{self.pick(""," href=#"," class=x")}>{self.words(1, 3)}</{t}> {self.words(1, 9)}'
        return text

    def content_block(self) -> str:
        k = self.r.random()
        if k < 0.68:
            opening = "<p>" + self.some(0.15, lambda: "<b>")
            return opening + self.prose() + self.pick("</p>", "</p>", "", "<br>")
        if k < 0.78:
            h = self.pick("h2", "h3")
            return f"<{h}>{self.MARK}{self.words(1, 7)}</{h}>"
        if k < 0.88:
            return "<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if k < 0.95:
            return f"<pre>{self.prose()}</pre>"
        if k < 0.98:
            return "<table>" + "".join(f"<tr><td>{self.prose()}</td><td>{self.MARK}{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(1, 3))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.prose()}</figcaption></figure>"

    def junk(self) -> str:
        """A part that isn't content; some bear a word that content bears elsewhere, so that no word alone decides."""
        part = self._junk()
        if self.r.random() < 0.12:
            flattered = f'class="{self.pick(*FLATTERING)} '
            part = part.replace('class="', flattered, 1)
        return part

    def _junk(self) -> str:
        r = self.r
        kind = self.pick("ad", "ad", "side", "notice", "form", "share", "menu", "comments", "noscript")
        say = lambda: self.pick(self.words(2, 12), f"<p>{self.words(2, 40)}</p>", f"<p>{self.words(2, 9)}</p>")
        if kind == "ad":
            return f'<{(t := self.pick("div", "div", "aside", "section"))} {self.pick("class", "id", "class")}="{self.pick("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot", "sponsor")}">{say()}{self.some(0.3, say)}</{t}>'
        if kind == "side":
            return f'<{(t := self.pick("aside", "div", "section"))}{self.pick("", " class=sidebar", " id=sidebar", " class=related", " class=widget", " role=complementary", " class=recommended") if t == "aside" else self.pick(" class=sidebar", " id=sidebar", " class=related-posts", " class=widget", " class=side", " class=trending")}>{self.pick(f"<h3>{self.words(1, 4)}</h3>", "")}{self.pick(f"<ul>{self.links()}</ul>", say())}{self.some(0.4, say)}</{t}>'
        if kind == "noscript":
            return f"<noscript>{say()}</noscript>"
        if kind == "notice":
            return f'<div {self.pick("class", "id")}="{self.pick("cookie", "cookie-notice", "notice", "alert", "consent", "gdpr-banner", "popup", "modal", "cookie-banner", "newsletter", "subscribe", "paywall")}"{self.some(0.2, lambda: " role=alert")}>{say()}{self.some(0.4, lambda: f"<button>{self.words(1, 3)}</button>")}</div>'
        if kind == "form":
            return f'<form{self.pick("", " class=search", " id=login", " class=signup")}><label>{self.words(1, 4)}</label><input name=q>{self.some(0.3, lambda: f"<select>{''.join(f'<option>{self.words(1, 3)}</option>' for _ in range(r.randint(2, 6)))}</select>")}{self.some(0.5, say)}<button>{self.words(1, 2)}</button></form>'
        if kind == "share":
            return f'<div class="{self.pick("share", "social", "tags", "breadcrumb", "breadcrumbs", "meta", "byline", "pagination", "toolbar")}">{self.pick(self.links("span"), self.words(1, 6))}</div>'
        if kind == "menu":
            return f'<{(t := self.pick("nav", "div", "ul"))}{"" if t == "nav" else self.pick(" class=menu", " class=nav", " id=navigation", " role=navigation")}>{self.links()}</{t}>'
        one = lambda: f'<{(t := self.pick("div", "li", "article", "div"))} class="{self.pick("comment", "comment-body", "reply", "comment")}">{self.some(0.5, lambda: f"<b>{self.words(1, 2)}</b>")}<p>{self.words(3, 60)}</p></{t}>'
        return f'<{(t := self.pick("section", "div", "ol"))} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "responses", "discussion", "reader-comments", "disqus-thread")}">{self.some(0.5, lambda: f"<h2>{self.words(1, 3)}</h2>")}{"".join(one() for _ in range(self.r.randint(1, 5)))}</{t}>'

    def name(self) -> str:
        """A class word of no meaning."""
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(2, 3)))

    def container(self) -> tuple[str, str]:
        """An element for the content and its attributes, or none for the body itself."""
        r = self.r
        tag = self.pick("article", "article", "main", "div", "div", "div", "section", "td", "")
        words = []
        if tag in ("div", "section") or r.random() < 0.2:
            words = [self.pick("content", "post", "entry-content", "article-body", "main", "story", "post-content", "text", "page-content", "prose", "")]
            if r.random() < 0.5:
                words = []
        if r.random() < 0.4:
            words.append(self.name())
        if r.random() < 0.45:
            words.append(self.pick(*MISLEADING))
        words = [w for w in words if w]
        if not words:
            return tag, ""
        return tag, f' {self.pick("class", "class", "id")}="{" ".join(words)}"' + self.some(0.05, lambda: ' role="main"')

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.2  # content without any stops beside other parts that have them
        inner = [f"<h1>{self.MARK}{self.words(2, 12)}</h1>"] if r.random() < 0.85 else []
        self.terse = r.choice((0.1, 0.25, 0.25, 0.95))
        for _ in range(r.randint(1, r.choice((12, 12, 12, 40, 120)))):
            self.stops = 0.0 if plain else 0.15
            inner.append(self.content_block())
            self.stops = 0.15
            if r.random() < 0.08:
                inner.append(self.junk())
        tag, names = self.container()
        inside = "".join(inner)
        # Some pages have their content in the body itself, or in a part of the page that nothing marks.
        body = inside if tag == "" else f"<{tag}{names}>{inside}</{tag}>"
        if tag and r.random() < 0.35:
            body = f'<{(t := self.pick("div", "main", "div", "section"))}{self.pick("", "", " class=container", " id=wrapper", " class=row", " class=page", f" class={self.name()}")}>{self.some(0.3, self.junk)}{body}{self.some(0.3, self.junk)}</{t}>'
        before = "".join(self.junk() for _ in range(r.randint(0, 3)))
        after = "".join(self.junk() for _ in range(r.randint(0, 3)))
        head = self.some(0.6, lambda: f'<{(t := self.pick("header", "header", "div"))}{" class=header" if t == "div" else ""}>{self.pick(f"<h2>{self.words(1, 4)}</h2>", self.words(1, 8))}{self.some(0.5, lambda: f"<nav><ul>{self.links()}</ul></nav>")}</{t}>')
        nav = self.some(0.6, lambda: f"<nav><ul>{self.links()}</ul></nav>")
        foot = self.some(0.9, lambda: f'<{(t := self.pick("footer", "footer", "footer", "div"))}{self.pick(" class=footer", " id=footer") if t == "div" else ""}>{self.pick("&copy; ", "")}{self.words(2, 30)}{self.some(0.4, lambda: f"<ul>{self.links()}</ul>")}</{t}>')
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{head}{nav}{before}{body}{after}{foot}</body></html>"

    def labelled(self) -> tuple[Page, list[int]]:
        """A tree and its labels: a leaf with the mark is content, and so is every element around one."""
        page = parse(self.page())
        labels = [0] * len(page.tags)
        for i in range(len(labels) - 1, 0, -1):
            if page.texts[i] is not None and self.MARK in page.texts[i]:
                labels[i] = 1
                page.texts[i] = page.texts[i].replace(self.MARK, "")
            if labels[i]:
                labels[page.parents[i]] = 1
        for i, inline in enumerate(page.inline):  # an inline element goes with its run
            if inline:
                labels[i] = labels[page.parents[i]]
        return page, labels


#: Labelled pages of the fit, and their seed.
TRAINING_PAGES, SEED = 1200, 11
_models: dict[tuple[int, int], TreeModel] = {}


def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> TreeModel:
    """The model of a setting, fitted once for each process."""
    if (pages, seed) not in _models:
        maker = Maker(seed)
        _models[pages, seed] = TreeModel().fit([maker.labelled() for _ in range(pages)])
    return _models[pages, seed]


def main_text(df: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null page is an empty one and has an empty text, as has a page without content. Ids and addresses may be null or
    repeat; each page is read by itself and whole, in time proportional to its length. White space is what Unicode calls so,
    no-break spaces too. A tag that never ends is dropped with what it holds, as browsers do; an element of raw text without
    an end tag holds nothing, but for scripts and styles, which go on to the end. A run that is as likely content as not is
    kept. An empty table gives no rows; further columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.extract(x or "") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
