"""Labelled pages for the HTML model, composed from the usual parts of web pages.

Every element of a composed page carries ``data-y``: 1 if it holds text of the article, else 0.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo zu an el in or ur".split()
WRAPPERS = ['article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'section class="article-body"', 'div id="article"', 'div class="story"', "section", "div"]
#: Frames around all parts of a page; their names tell what the page has, not what they are.
FRAMES = ['div class="wrapper has-sidebar"', 'div id="page" class="site with-footer"', 'div class="layout no-header"', 'div id="wrapper"', 'div class="page has-menu"', 'div class="container"']


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        n = self.r.randint(least, most)
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)).capitalize() + self.r.choice([".", ".", "", "!"])

    def link(self, n: int = 2) -> str:
        return f'<a href="/{self.r.choice(SYLLABLES)}">{self.words(1, n)}</a>'

    def element(self, start: str, y: int, inner: str, close: bool = True) -> str:
        tag = start.split()[0]
        return f'<{start} data-y="{y}">{inner}' + (f"</{tag}>" if close else "")

    def links(self, y: int = 0) -> str:
        items = [self.element("li", y, self.link()) for _ in range(self.r.randint(2, 8))]
        return self.element("ul", y, "".join(items)) if self.r.random() < 0.7 else "".join(self.link() for _ in items)

    def paragraph(self) -> str:
        text = self.words(1, self.r.choice([2, 8, 30, 90]))
        if self.r.random() < 0.2:
            text = f"{self.r.choice(['<b>', '<em>', '<strong>'])}{text}<br>"
        if self.r.random() < 0.2:
            text += " " + self.link(3)
        return self.element("p", 1, text, self.r.random() < 0.85)

    def content(self) -> str:
        kind = self.r.random()
        if kind < 0.68:
            return self.paragraph()
        if kind < 0.76:
            return self.element(self.r.choice(["h2", "h3", "h4"]), 1, self.words(1, 8))
        if kind < 0.84:
            return self.element(self.r.choice(["ul", "ol"]), 1, "".join(self.element("li", 1, self.words(1, 20)) for _ in range(self.r.randint(1, 6))))
        if kind < 0.88:
            return self.element("blockquote", 1, self.paragraph() if self.r.random() < 0.5 else self.words(3, 30))
        if kind < 0.91:
            rows = "".join(self.element("tr", 1, "".join(self.element("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(self.r.randint(1, 4)))
            return self.element("table", 1, rows)
        if kind < 0.94:
            return self.element("figure", 1, '<img src="x.png">' + self.element("figcaption", 1, self.words(2, 10)))
        if kind < 0.97:
            return self.element(self.r.choice(["div", "section"]), 1, "".join(self.paragraph() for _ in range(self.r.randint(1, 4))))
        return self.element("div", 1, self.words(4, 60))

    def inserted(self) -> str:
        """Parts that are not content though they stand in the article."""
        return self.r.choice([self.advert, self.share, self.notice, self.related, self.form])()

    def advert(self) -> str:
        start = self.r.choice(['div class="ad"', 'div class="advert"', 'div id="ad-1"', 'div class="sponsored"', 'aside class="promo"', 'section class="advertisement"', 'div class="ads banner"'])
        inner = self.words(2, 30) if self.r.random() < 0.6 else self.element("p", 0, self.words(2, 20) + self.link())
        return self.element(start, 0, inner)

    def share(self) -> str:
        return self.element(self.r.choice(['div class="share"', 'div class="social-links"', 'ul class="share-buttons"']), 0, "".join(self.link(1) for _ in range(3)))

    def notice(self) -> str:
        start = self.r.choice(['div class="cookie-notice"', 'div id="cookie-consent"', 'div class="newsletter"', 'section class="notice"', 'div role="alert"', 'div class="gdpr popup"', 'dialog', 'div class="alert"', 'div class="subscribe"'])
        inner = self.element("p", 0, self.words(4, 30)) if self.r.random() < 0.6 else self.words(4, 30)
        return self.element(start, 0, inner + (self.element("button", 0, self.words(1, 2)) if self.r.random() < 0.6 else ""))

    def related(self) -> str:
        start = self.r.choice(["aside", 'aside class="sidebar"', 'div class="sidebar"', 'div class="related"', 'section class="related-posts"', 'div id="sidebar"', 'div class="widget"'])
        parts = [self.element(self.r.choice(["h2", "h3", "h4"]), 0, self.words(1, 4)), self.links(), self.element("p", 0, self.words(2, 40)), self.element("div", 0, self.words(2, 25))]
        return self.element(start, 0, "".join(self.r.sample(parts, self.r.randint(1, 4))))

    def form(self) -> str:
        start = self.r.choice(["form", 'form class="search"', 'form id="login"', 'form class="contact"', 'div class="search-form"'])
        fields = self.words(1, 6) + '<input type="text">' + self.element("button", 0, self.words(1, 2))
        return self.element(start, 0, self.element("p", 0, fields) if self.r.random() < 0.4 else f"<label>{self.words(1, 4)}</label>" + fields)

    def comments(self) -> str:
        start = self.r.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'section id="reader-comments"', 'div class="discussion"'])
        inner = self.r.choice(['div class="comment"', 'li class="comment"', 'article class="comment"', "div", "p"])
        each = lambda: self.words(2, 60) if inner == "p" or self.r.random() < 0.4 else self.element("p", 0, self.words(2, 60))
        head = self.element("h3", 0, self.words(1, 3)) if self.r.random() < 0.6 else ""
        return self.element(start, 0, head + "".join(self.element(inner, 0, each()) for _ in range(self.r.randint(1, 6))))

    def menu(self) -> str:
        start = self.r.choice(["nav", "nav", 'nav class="menu"', 'div class="navbar"', 'div id="menu"', 'ul class="breadcrumb"', 'div class="navigation"', 'div role="navigation"'])
        return self.element(start, 0, self.links())

    def header(self) -> str:
        start = self.r.choice(["header", "header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="topbar"', 'div role="banner"'])
        parts = [self.element(self.r.choice(["h1", "div", "p"]), 0, self.words(1, 4)), self.element("p", 0, self.words(2, 12)), self.menu(), self.words(1, 5)]
        return self.element(start, 0, "".join(self.r.sample(parts, self.r.randint(1, 3))))

    def footer(self) -> str:
        start = self.r.choice(["footer", "footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div role="contentinfo"'])
        parts = ["&copy; " + self.words(2, 20), self.element("p", 0, self.words(3, 25)), self.links(), self.element("div", 0, self.words(2, 12))]
        return self.element(start, 0, "".join(self.r.sample(parts, self.r.randint(1, 3))))

    def article(self) -> str:
        parts = [self.content() for _ in range(self.r.choice([0, 1, 2, 4, 8, 16]))]
        if self.r.random() < 0.4:
            for _ in range(self.r.randint(1, 2)):
                parts.insert(self.r.randint(0, len(parts)), self.inserted())
        head = self.element("h1", 1, self.words(1, 9))
        if self.r.random() < 0.1:
            head = ""
            parts = parts or [self.paragraph()]
        if self.r.random() < 0.15:
            parts.append(self.comments())
        if self.r.random() < 0.1:
            parts.append(self.element("footer", 0, self.words(2, 10)))
        whole = self.element(self.r.choice(WRAPPERS), 1, head + "".join(parts))
        for _ in range(self.r.choice([0, 0, 1, 2])):
            extra = [self.related()] if self.r.random() < 0.3 else []
            self.r.shuffle(extra)
            whole = self.element(self.r.choice(["div", "main", 'div class="wrapper"', 'div id="page"', "section", 'div class="container"']), 1, whole + "".join(extra))
        return whole

    def script_notice(self) -> str:
        return self.element("noscript", 0, self.words(3, 20))

    def page(self) -> str:
        kind = self.r.random()
        if kind < 0.03:  # plain text
            return self.words(5, 300)
        if kind < 0.1:  # paragraphs without a frame
            return "".join(self.content() for _ in range(self.r.randint(1, 12)))
        before = [f() for f in (self.header, self.menu, self.advert, self.notice, self.form, self.script_notice) if self.r.random() < 0.45]
        after = [f() for f in (self.related, self.comments, self.advert, self.notice, self.form, self.footer, self.script_notice) if self.r.random() < 0.4]
        self.r.shuffle(before)
        inner = "".join(before) + self.article() + "".join(after)
        if kind < 0.2:  # a form around the whole page
            inner = self.element(self.r.choice(["form", 'form id="aspnetForm"', 'form class="page"']), 1, inner)
        elif kind < 0.35:
            inner = self.element(self.r.choice(FRAMES), 1, inner)
        body = self.element("body", 1, inner)
        head = f"<head><title>{self.words(1, 8)}</title><style>p{{}}</style></head>"
        return f'<!DOCTYPE html><html data-y="1">{head}{body}</html>'


def labelled_pages(n: int, seed: int = 808) -> list[str]:
    composer = Composer(seed)
    return [composer.page() for _ in range(n)]
