"""HTML extraction by a tree-structured graphical model.

A page's elements form a tree; each element is content (it holds text of the article) or not.  Unary potentials weigh
an element's tag, the words in its class, id and role, the length of its own text and of all text below it, the share of
the page's text that this is, and the share of links in it; parent-child potentials connect it with its parent.  Sum-product messages go upward and downward, level by level for
a batch of pages at once, and give each element's marginal.  Text is kept where the marginal of its element is at least one half.

Weights are trained by maximum likelihood, with the same messages, on ``TRAINING_PAGES`` labelled pages that
:mod:`boxloom.llm.html_training` composes from the usual parts of web pages.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
an empty line in page order.

Tags and attributes end where HTML ends them, stray quotes included; a quote that is never closed ends with its tag, a
comment or raw element that is never closed is skipped as a lone tag, and a tag that the page ends in is left out.
Pages are read in time linear in their length, whatever it is.

Defined results: a null, empty or text-free html gives an empty text; unclosed and stray tags are repaired; comments,
scripts, styles, templates, titles and the fields of forms never hold text; plain text is one block; an element whose
marginal is exactly one half is kept; repeated rows are each extracted; an empty table gives an
empty result; other columns are kept, columns named like the output are replaced.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table

TRAINING_PAGES, ROUNDS, RATE, PENALTY = 400, 250, 0.1, 1e-3
PAGES = 256  # in a batch of inference

#: A tag without stray quotes; others are read attribute by attribute.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><"'=]*+)((?:[^<>"'=]++|=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=]++))*+)>""")
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
NAME_OF_TAG, GAP, NAME, EQUALS, UNQUOTED = map(re.compile, (r"<(/?)([a-zA-Z][^\s/>]*+)", r"[\s/]*+", r"=?+[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
COMMENT_END = re.compile("--!?>")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
BLANK = re.compile(r"\s+")
#: Elements by what they do in a page (fixed lists of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title iframe textarea select".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var
    audio canvas map object picture video math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow
    ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg circle defs desc ellipse g line path polygon polyline rect
    text tspan use""".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that begins closes the nearest open one of these with all in it, if no parent of those named lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TAGS = ["other", "html", "body", "head", "article", "main", "section", "div", "p", "h1", "heading", "list", "li", "quote", "table", "cell", "figure", "nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "noscript"]
SAME_TAG = {"h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "blockquote": "quote", "pre": "quote", "tr": "table", "tbody": "table", "thead": "table", "td": "cell", "th": "cell", "figcaption": "figure", "fieldset": "form"}
#: Words in class, id and role by the part of a page that they name (fixed lists).
NAMES = [
    ("content", "content|article|post|entry|story|main|body|text|prose"),
    ("menu", "nav|navbar|navigation|menu|breadcrumbs?|toc|tabs|pagination|pager|toolbar|skip"),
    ("header", "header|masthead|topbar|brand|logo|banner"),
    ("footer", "footer|copyright|colophon|legal|bottom"),
    ("aside", "sidebar|aside|related|widgets?|rail|recommended|trending|popular|complementary|teasers?|more"),
    ("notice", "cookies?|consent|gdpr|notices?|alerts?|popup|modal|dialog|overlay|toast|subscribe|newsletter|signup|paywall|contentinfo"),
    ("advert", "ads?|advert|advertisement|adverts|sponsor|sponsored|promo|promotion|dfp|banner-ad|outbrain|taboola"),
    ("comments", "comments?|reply|replies|respond|disqus|discussion|reviews?|reader"),
    ("share", "share|sharing|social|follow|tweet|byline|meta|tags|author"),
    ("form", "form|search|login|input|contact"),
]
NAMED = [(name, re.compile(rf"(?<![a-z])(?:{words})(?![a-z])", re.I)) for name, words in NAMES]
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LENGTHS, LINKS, BELOW, SHARES = [1, 20, 60, 150, 400], [0.01, 0.3, 0.6, 0.9], [100, 400, 1500, 6000], [0.05, 0.2, 0.5, 0.8]
#: Number of each unary feature: tags, then names, then lengths, link shares, lengths below and shares of the page; 0 is always on.
TAG_AT = 1
NAME_AT = TAG_AT + len(TAGS)
LENGTH_AT = NAME_AT + len(NAMED) + 1
LINK_AT = LENGTH_AT + len(LENGTHS) + 1
BELOW_AT = LINK_AT + len(LINKS) + 1
SHARE_AT = BELOW_AT + len(BELOW) + 1
FEATURES = SHARE_AT + len(SHARES) + 1
TAG_NUMBER = {name: i for i, name in enumerate(TAGS)} | {tag: TAGS.index(name) for tag, name in SAME_TAG.items()}


@lru_cache(1 << 16)
def names_in(value: str) -> tuple[int, ...]:
    value = CAMEL.sub("-", value)
    return tuple(NAME_AT + i for i, (_, pattern) in enumerate(NAMED) if pattern.search(value))


class Page:
    """Elements in page order and blocks of text.  ``tags``, ``parents``, ``depths``, ``marks`` have an entry for each
    element; ``blocks``: (element, text, characters in links).  Labels are read from composed pages only."""

    def __init__(self, html: str, labelled: bool = False):
        self.tags, self.parents, self.depths = ["#root"], [-1], [0]
        self.marks: list[tuple[int, ...]] = [()]
        self.labels: list[int] = [int(labelled)]
        self.blocks: list[tuple[int, str, int]] = []
        self.html, self.labelled = html, labelled
        self.missing: set[str] = set()  # what does not come again in the rest of the page
        self.read()

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, or -1; a search in vain is made once."""
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag(self, at: int) -> tuple[str, str, list[tuple[str, str]] | str, int] | None:
        """Slash, name, attributes and end of the tag at a place; None if the page ends in it."""
        html, n = self.html, len(self.html)
        if m := TAG.match(html, at):
            return m[1], m[2].lower(), m[3], m.end()
        m, found = NAME_OF_TAG.match(html, at), []
        slash, name, at = m[1], m[2].lower(), m.end()
        while True:
            at = GAP.match(html, at).end()
            if at >= n:
                return None
            if html[at] == ">":
                return slash, name, found, at + 1
            start, at = at, NAME.match(html, at).end()
            key, value = html[start:at], ""
            if equals := EQUALS.match(html, at):
                at = equals.end()
                end = self.find(html[at], at + 1) if html[at : at + 1] in ('"', "'") else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    start, at = at, UNQUOTED.match(html, at).end()
                    value = html[start:at]
            found.append((key, value))

    def after_mark(self, at: int) -> int:
        """The end of a comment, declaration or other mark that is no tag."""
        html = self.html
        if html.startswith("<!--", at):
            for empty in ("<!-->", "<!--->"):
                if html.startswith(empty, at):
                    return at + len(empty)
            if "--" not in self.missing:
                if m := COMMENT_END.search(html, at + 4):
                    return m.end()
                self.missing.add("--")
        end = self.find(">", at)
        return end + 1 if end >= 0 else len(html)

    def marks_of(self, tag: str, attributes: list[tuple[str, str]] | str) -> tuple[tuple[int, ...], int]:
        if isinstance(attributes, str):
            attributes = [(m[1], m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)]
        marks, label = (), 0
        for name, value in attributes:
            name = name.lower()
            if name in ("class", "id", "role", "itemprop"):
                if tag not in ("html", "body"):  # there they name the page, not a part of it
                    marks += names_in(value)
            elif name == "hidden" or (name == "style" and HIDING.search(value)):
                marks += (NAME_AT + len(NAMED),)
            elif name == "data-y" and self.labelled:
                label = int(value)
        return marks, label

    def read(self) -> None:
        html = self.html
        stack, held, linked, in_link = [0], [], 0, 0
        is_open: dict[str, int] = {}

        def flush():
            nonlocal linked
            text = BLANK.sub(" ", "".join(held)).strip()
            if text:
                self.blocks.append((stack[-1], text, linked))
            held.clear()
            linked = 0

        def add(text: str):
            nonlocal linked
            if "&" in text:
                text = unescape(text)
            held.append(text)
            if in_link:
                linked += len(text)

        def close(tags, until=()):
            """Closes the nearest open element of the given tags."""
            if any(is_open.get(t) for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tags[stack[k]]
                    if tag in tags:
                        for i in stack[k:]:
                            is_open[self.tags[i]] -= 1
                        del stack[k:]
                        return
                    if tag in until:
                        return

        at, shown = 0, 0  # text from ``shown`` on is not yet added
        while True:
            at = html.find("<", at)
            if at < 0:
                break
            after = html[at + 1 : at + 3]
            if not (after[:1].isascii() and after[:1].isalpha()) and not (after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
                if after[:1] not in ("!", "?", "/") or not after:
                    at += 1
                    continue
                if shown < at:
                    add(html[shown:at])
                at = shown = self.after_mark(at)
                continue
            if shown < at:
                add(html[shown:at])
            found = self.tag(at)
            if found is None:
                shown = len(html)
                break
            slash, tag, attributes, at = found
            shown = at
            if slash:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                if tag not in INLINE:
                    flush()
                    in_link = 0
                    close((tag,))
            elif tag == "br":
                held.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
            elif tag in RAW:
                empty = isinstance(attributes, str) and attributes.rstrip().endswith("/")
                if not empty and tag not in self.missing:
                    if end := RAW_END[tag].search(html, at):
                        at = shown = end.end()
                    else:
                        self.missing.add(tag)
                if tag not in ("script", "style", "template"):
                    held.append(" ")
            elif tag in INLINE:
                in_link += tag == "a"
            else:
                flush()
                in_link = 0
                if tag in CLOSES_P and self.tags[stack[-1]] == "p":
                    close(("p",))
                if tag in CLOSES:
                    close(*CLOSES[tag])
                marks, label = self.marks_of(tag, attributes) if attributes else ((), 0)
                self.tags.append(tag)
                self.parents.append(stack[-1])
                self.depths.append(self.depths[stack[-1]] + 1)
                self.marks.append(marks)
                self.labels.append(label)
                stack.append(len(self.tags) - 1)
                is_open[tag] = is_open.get(tag, 0) + 1
        if shown < len(html):
            add(html[shown:])
        flush()


class Forest:
    """The elements of some pages as arrays, ordered so that a level of the trees is a slice of ``order``."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *[len(p.tags) for p in pages]])
        n = starts[-1]
        self.starts = starts
        self.parent = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, starts, strict=False)]) if n else np.empty(0, int)
        depth = np.concatenate([np.array(p.depths) for p in pages]) if n else np.empty(0, int)
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order], prepend=-1))
        self.levels = np.split(order, cuts[1:]) if n else []
        chars, links = np.zeros(n), np.zeros(n)
        rows, columns = [np.arange(n)], [np.zeros(n, int)]
        tags = np.array([TAG_NUMBER.get(t, 0) for p in pages for t in p.tags], int)
        rows.append(np.arange(n))
        columns.append(TAG_AT + tags)
        marked = [(s + i, k) for p, s in zip(pages, starts, strict=False) for i, m in enumerate(p.marks) if m for k in set(m)]
        if marked:
            rows.append(np.array([x[0] for x in marked]))
            columns.append(np.array([x[1] for x in marked]))
        for p, s in zip(pages, starts, strict=False):
            for i, text, linked in p.blocks:
                chars[s + i] += len(text)
                links[s + i] += linked
        deep_chars, deep_links = chars.copy(), links.copy()  # of the element with all below it
        for level in self.levels[:0:-1]:
            np.add.at(deep_chars, self.parent[level], deep_chars[level])
            np.add.at(deep_links, self.parent[level], deep_links[level])
        whole = np.maximum(np.repeat(deep_chars[starts[:-1]], np.diff(starts)), 1)
        rows += [np.arange(n)] * 4
        columns += [LENGTH_AT + np.digitize(chars, LENGTHS), LINK_AT + np.digitize(deep_links / np.maximum(deep_chars, 1), LINKS), BELOW_AT + np.digitize(deep_chars, BELOW), SHARE_AT + np.digitize(deep_chars / whole, SHARES)]
        self.rows, self.columns, self.n = np.concatenate(rows), np.concatenate(columns), n
        self.kind = tags  # the parent-child table of an element is that of its tag

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.n)


def sum_product(forest: Forest, unary: np.ndarray, tables: np.ndarray):
    """Marginals of content, and for each element the joint marginals of its parent and itself.
    ``tables[kind, y of parent, y of child]`` are log potentials."""
    n, parent = forest.n, forest.parent
    up = np.zeros((n, 2))  # log belief from below, with the own potential
    up[:, 1] = unary
    message = np.zeros((n, 2))  # from an element to its parent
    for level in forest.levels[:0:-1]:
        joint = tables[forest.kind[level]] + up[level][:, None, :]
        message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(up, parent[level], message[level])
    full = up.copy()
    pair = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        joint = (full[parent[level]] - message[level])[:, :, None] + tables[forest.kind[level]] + up[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        joint /= joint.sum((1, 2), keepdims=True)
        pair[level] = joint
        with np.errstate(divide="ignore"):
            full[level] = np.log(np.maximum(joint.sum(1), 1e-300))
    top = full - full.max(1, keepdims=True)
    belief = np.exp(top)
    return belief[:, 1] / belief.sum(1), pair


def train(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and parent-child tables of greatest penalized likelihood, by gradient ascent with moments (Adam)."""
    forest = Forest(pages)
    y = np.array([v for p in pages for v in p.labels])
    child = np.flatnonzero(forest.parent >= 0)
    state = np.zeros(FEATURES + len(TAGS) * 4)
    first, second = np.zeros_like(state), np.zeros_like(state)
    seen_pairs = np.zeros((len(TAGS), 2, 2))
    np.add.at(seen_pairs, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    for t in range(1, ROUNDS + 1):
        weights, tables = state[:FEATURES], state[FEATURES:].reshape(-1, 2, 2)
        marginal, pair = sum_product(forest, forest.unary(weights), tables)
        gradient = np.zeros_like(state)
        gradient[:FEATURES] = np.bincount(forest.columns, (y - marginal)[forest.rows], FEATURES)
        expected = np.zeros_like(seen_pairs)
        np.add.at(expected, forest.kind[child], pair[child])
        gradient[FEATURES:] = (seen_pairs - expected).ravel()
        gradient = gradient / len(pages) - PENALTY * state
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        state = state + RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return state[:FEATURES], state[FEATURES:].reshape(-1, 2, 2)


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    from .html_training import labelled_pages

    return train([Page(html, labelled=True) for html in labelled_pages(TRAINING_PAGES)])


def extract(htmls: list[str | None], weights: np.ndarray, tables: np.ndarray) -> list[str]:
    pages = [Page(x or "") for x in htmls]
    forest = Forest(pages)
    marginal, _ = sum_product(forest, forest.unary(weights), tables)
    return ["\n\n".join(text for i, text, _ in p.blocks if marginal[s + i] >= 0.5) for p, s in zip(pages, forest.starts, strict=False)]


def extract_text(df: DataFrame, html: str = "html", text: str = "text", keep_html: bool = False) -> DataFrame:
    """``df`` with the main text, its length n_chars, and without the html unless it is to be kept."""
    bound_batches(df.sparkSession)
    df = df.drop(text, "n_chars")
    sent = df.sparkSession.sparkContext.broadcast(model())
    kept = [f for f in df.schema.fields if keep_html or f.name != html]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                texts = extract(part[html].to_pylist(), *sent.value)
                yield pa.RecordBatch.from_arrays([*[part[f.name] for f in kept], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*[f.name for f in kept], text, "n_chars"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())]))


def op9_html_extraction(spark, sf_dir) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
