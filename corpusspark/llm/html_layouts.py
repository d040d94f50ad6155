"""Labelled pages for training the block field: invented text in common page layouts, with the main text known.

A page is a list of parts around and inside a container of the main text.  Containers, parts, their tags and their
class names are drawn at random, so that no single sign of a part is always there.
"""

from __future__ import annotations

import random

MAIN_NAMES = "content post entry-content article-body story-body post-content main-content article text body-text page-content markdown-body".split()
#: kind: (tags, class names); parts of these kinds are never main text.
CLUTTER = {
    "nav": (["nav", "div", "ul"], "nav menu navbar main-menu top-nav site-nav breadcrumbs breadcrumb pagination pager tabs toc".split()),
    "header": (["header", "div"], "header site-header masthead banner top-bar branding logo page-header".split()),
    "footer": (["footer", "div"], "footer site-footer page-footer colophon copyright legal bottom".split()),
    "aside": (["aside", "div"], "sidebar aside widget related related-posts recommended popular trending teaser side-column more-stories".split()),
    "notice": (["div", "section", "aside"], "cookie cookie-notice consent gdpr notice alert banner-notice popup modal overlay message subscribe-notice".split()),
    "ad": (["div", "aside", "section", "ins"], "ad ads advert advertisement sponsor sponsored promo promotion ad-slot banner-ad adsbygoogle".split()),
    "form": (["form"], "search newsletter signup login contact-form subscribe search-form".split()),
    "comments": (["section", "div", "ol", "ul"], "comments comment comment-list reader-comments discussion replies respond disqus user-comments".split()),
    "share": (["div", "ul", "p"], "share social share-buttons follow social-links meta tags tag-list byline post-meta author-box".split()),
}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.main: set[str] = set()
        self.seen = 0

    def words(self, low: int, high: int) -> str:
        r = self.rng
        made = ["".join(r.choice(("an", "er", "ou", "th", "in", "sch", "que", "lo", "é", "ció", "ra", "st", "he")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(w + (r.choice(",.") if r.random() < 0.12 else "") for w in made)

    def sentence(self, low: int, high: int, main: bool) -> str:
        self.seen += 1
        text = self.words(low, high).capitalize() + self.rng.choice((".", ".", ".", "!", "?", "", ""))
        if main:
            self.main.add(text)
        return text

    def paragraph(self) -> str:
        r, tag = self.rng, self.rng.choice(("p",) * 12 + ("li", "blockquote", "h2", "h3", "td", "pre", "div"))
        text = self.sentence(1, 6, True) if tag in ("h2", "h3") else self.sentence(*r.choice(((1, 4), (5, 30), (20, 120), (80, 300))), True)
        if r.random() < 0.15:
            return f"<p><b>{text}<br>"
        if tag == "li":
            return f"<ul><li>{text}</li></ul>"
        if tag == "td":
            return f"<table><tr><td>{text}</td></tr></table>"
        if r.random() < 0.1:
            return f"<p><a href=\"/x\">{text}</a></p>"
        return f"<{tag}>{text}" + ("" if tag == "p" and r.random() < 0.1 else f"</{tag}>")

    def part(self, kind: str) -> str:
        r = self.rng
        tags, names = CLUTTER[kind]
        tag = r.choice(tags)
        name = r.choice(names)
        mark = "" if tag == kind and r.random() < 0.5 else f' {r.choice(("class", "class", "id"))}="{name}"'
        if kind in ("nav", "share") or kind in ("footer", "aside") and r.random() < 0.4:
            inner = "".join(f'<li><a href="/{i}">{self.sentence(1, 4, False)}</a></li>' for i in range(r.randint(1, 8)))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f'<label>{self.sentence(1, 5, False)}</label><input name="q"><p>{self.sentence(2, 20, False)}</p><button>{self.sentence(1, 2, False)}</button>'
        elif kind == "comments":
            each = r.choice(("article", "div", "li"))
            inner = "".join(f'<{each}{r.choice(("", " class=comment", " class=reply"))}><p>{self.sentence(3, 60, False)}</p></{each}>' for _ in range(r.randint(1, 5)))
            inner = f"<h3>{self.sentence(1, 3, False)}</h3>" * (r.random() < 0.5) + inner
        else:
            inner = "".join(r.choice(("<p>{}</p>", "{}", "<div>{}</div>", "<h3>{}</h3>", "<span>{}</span>")).format(self.sentence(*r.choice(((1, 6), (4, 25), (20, 60))), False)) for _ in range(r.randint(1, 3)))
            if kind == "footer" and r.random() < 0.6:
                inner = "&copy; " + inner
        return f"<{tag}{mark}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.rng
        container = r.choice(("article", "article", "article", "main", "div", "section", "main-article"))
        mark = f' {r.choice(("class", "id"))}="{r.choice(MAIN_NAMES)}"' if container in ("div", "section") or r.random() < 0.3 else ""
        opened, closed = (f"<main><article{mark}>", "</article></main>") if container == "main-article" else (f"<{container}{mark}>", f"</{container}>")
        title = f"<h1>{self.sentence(1, 12, True)}</h1>"
        body = [self.paragraph() for _ in range(r.choice((0, 1, 2, 4, 8, 16, 24)))]
        for kind in ("ad", "share", "aside", "notice", "form", "nav", "comments"):
            if r.random() < 0.12:
                body.insert(r.randint(0, len(body)), self.part(kind))
        if r.random() < 0.15:
            title = f"<header>{title}</header>" if r.random() < 0.3 else ""
        if r.random() < 0.12:
            body.append(self.part("comments"))
        before = [self.part(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.45]
        after = [self.part(k) for k in ("share", "aside", "comments", "ad", "form", "nav", "footer", "notice") if r.random() < 0.4]
        if r.random() < 0.5:
            r.shuffle(before)
        if r.random() < 0.3:
            before, after = [f'<div class="wrapper"><div id="page">{"".join(before)}'], [*after, "</div></div>"]
        end = "</body></html>" if r.random() < 0.9 else ""
        return (f"<!DOCTYPE html><html><head><title>x</title><script>var t='</p>';</script></head><body>{''.join(before)}"
                f"{opened}{title}{''.join(body)}{closed}{''.join(after)}{end}")


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, set[str]]]:
    """(html, texts of the main blocks); the texts of other blocks are made apart from them by chance."""
    out = []
    for i in range(count):
        writer = _Writer(random.Random(seed * 1_000_003 + i))
        page = writer.page()
        out.append((page, {" ".join(t.split()) for t in writer.main}))
    return out
