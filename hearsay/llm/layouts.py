"""Pages of known structure for training: blocks of real pages laid out anew in layouts drawn at random.

``data-main`` says which elements hold the article; readers outside training never look at it.
"""

from __future__ import annotations

import html
import random

MAIN_NAMES = ("content", "post-content", "entry-content", "article-body", "story", "post", "text", "main-text", "body-copy", "single-post", "page-content", "articleBody")
NAMES = {
    "ad": ("ad", "ads", "advert", "banner", "sponsor", "sponsored", "promo", "ad-slot", "adsbygoogle", "advertisement", "partner-box"),
    "nav": ("nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "pager", "pagination", "tabs"),
    "header": ("header", "site-header", "masthead", "page-header", "branding", "logo", "top"),
    "footer": ("footer", "site-footer", "page-footer", "foot", "bottom", "copyright", "colophon", "legal"),
    "side": ("sidebar", "side", "widget", "aside", "rail", "related", "recent-posts", "popular", "tags", "more-stories", "right-column", "teaser"),
    "notice": ("cookie", "cookie-banner", "consent", "notice", "alert", "notification", "gdpr", "popup", "message", "paywall", "disclaimer", "newsletter"),
    "comments": ("comments", "comment-list", "discussion", "responses", "replies", "disqus", "user-comments", "reader-comments", "thread", "feedback"),
    "share": ("share", "social", "social-links", "share-buttons", "follow", "actions", "meta", "byline", "author-box", "post-meta"),
    "form": ("search", "search-form", "login", "subscribe", "signup", "contact", "comment-form", "poll"),
}
WORDS = (
    "home news about contact login register search archive next previous share reply like privacy terms cookies accept close menu sport "
    "weather culture help more subscribe newsletter top back read"
).split()
INLINE = ("b", "i", "em", "strong", "span", "code", "u", "small", "mark")


class Maker:
    def __init__(self, rng: random.Random, pool: list[str]):
        self.rng, self.pool = rng, pool

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def name(self, kind: str) -> str:
        """Attributes of a block of this kind; now and then none, or names that say nothing."""
        r = self.rng
        if self.chance(0.2):
            return r.choice(("", f' class="c{r.randrange(99)}"', ' class="box"', ' class="row"', ' class="col-8"', ' class="block"'))
        names = MAIN_NAMES if kind == "main" else NAMES[kind]
        some = r.choice(names)
        if self.chance(0.25):
            some += r.choice((" box", "-wrap", "-inner", " row", "-1", " clearfix", "_container"))
        return f' {r.choice(("class", "class", "id"))}="{some}"'

    def words(self, low: int, high: int) -> str:
        r = self.rng
        source = r.choice(self.pool).split() if self.pool and self.chance(0.6) else WORDS
        return " ".join(r.choice(source) for _ in range(r.randint(low, high)))

    def prose(self) -> str:
        """A block of a real page, or a part of it; sometimes a single word."""
        r = self.rng
        text = r.choice(self.pool) if self.pool else " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60))) + "."
        parts = text.split()
        if len(parts) > 4 and self.chance(0.4):
            n = r.choice((1, 2, 3, 5, 8, 13, 30, 80))
            start = r.randrange(len(parts))
            parts = parts[start : start + n]
        if self.chance(0.1):  # numbers, dates, codes
            parts = [w + str(r.randrange(1000)) if self.chance(0.5) else w for w in parts]
        return " ".join(parts)

    def marked(self, text: str) -> str:
        """``text`` escaped, with inline elements in it."""
        r = self.rng
        parts = [html.escape(w, quote=self.chance(0.5)) for w in text.split()]
        if len(parts) > 3 and self.chance(0.4):
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(parts))
                tag = r.choice((*INLINE, "a"))
                extra = ' href="/x"' if tag == "a" else ""
                parts[i] = f"<{tag}{extra}>{parts[i]}</{tag}>"
        if parts and self.chance(0.1):
            parts[r.randrange(len(parts))] += "<br>"
        return " ".join(parts)

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def p(self, text: str) -> str:
        style = self.rng.random()
        if style < 0.08:
            return f"<p><b>{self.marked(text)}<br>"
        return f"<p>{self.marked(text)}" + ("</p>" if style < 0.9 else "")

    def boiler(self, kind: str) -> str:
        r = self.rng
        at = self.name(kind) + ' data-main="0"'
        if kind == "nav":
            tag = r.choice(("nav", "nav", "div", "ul", "section"))
            if tag == "ul":
                return f"<ul{at}>{self.links(r.randint(2, 9))}</ul>"
            inner = f"<ul>{self.links(r.randint(2, 9))}</ul>" if self.chance(0.7) else " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 7)))
            return f"<{tag}{at}>{inner}</{tag}>"
        if kind == "header":
            inner = f"<h1>{self.words(1, 3)}</h1>" if self.chance(0.5) else f'<a href="/">{self.words(1, 3)}</a>'
            return f'<{(tag := r.choice(("header", "div")))}{at}>{inner}<p>{self.words(2, 9)}</p></{tag}>'
        if kind == "footer":
            inner = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose()}", f"<p>Copyright {r.randint(1999, 2030)} {self.words(2, 6)}</p><ul>{self.links(3)}</ul>", f"<p>{self.prose()}</p>", self.prose()))
            return f'<{(tag := r.choice(("footer", "footer", "div")))}{at}>{inner}</{tag}>'
        if kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" * self.chance(0.7)
            inner += r.choice((f"<ul>{self.links(r.randint(2, 8))}</ul>", f"<p>{html.escape(self.prose())}</p>", f'<div><a href="/y">{self.words(3, 9)}</a><p>{html.escape(self.prose())}</p></div>' * 2))
            return f'<{(tag := r.choice(("aside", "aside", "div", "section")))}{at}>{inner}</{tag}>'
        if kind == "notice":
            inner = html.escape(self.prose()) + f' <button>{self.words(1, 2)}</button>' * self.chance(0.5)
            return f"<div{at}>{inner if self.chance(0.5) else f'<p>{inner}</p>'}</div>"
        if kind == "comments":
            items = []
            for _ in range(r.randint(1, 7)):
                who = r.choice((f"<b>{self.words(1, 1)}</b>", f'<span class="author">{self.words(1, 2)}</span> <time>12:{r.randint(10, 59)}</time>', f'<div class="comment-author">{self.words(1, 2)}</div>', ""))
                body = f"<p>{html.escape(self.prose())}</p>" if self.chance(0.8) else html.escape(self.prose())
                one = f'{who}{body}' + '<a href="#">reply</a>' * self.chance(0.4)
                items.append(r.choice((f'<li class="comment">{one}</li>', f'<div class="comment">{one}</div>', f"<li>{one}</li>", f'<article class="comment">{one}</article>', f'<div class="reply">{one}</div>')))
            inner = "".join(items)
            inner = f"<ol>{inner}</ol>" if inner.startswith("<li") else inner
            tag = r.choice(("div", "div", "section", "aside", "ul" if inner.startswith("<li") else "div"))
            return f"<{tag}{at}>" + f"<h3>{r.randint(1, 99)} {self.words(1, 2)}</h3>" * self.chance(0.6) + f"{inner}</{tag}>"
        if kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>' + f"<p>{html.escape(self.prose())}</p>" * self.chance(0.4)
            return f"<form{at}>{inner}</form>"
        if kind == "share":
            return f"<div{at}>" + r.choice((" ".join(f'<a href="#">{self.words(1, 1)}</a>' for _ in range(4)), self.words(2, 8), f"<ul>{self.links(4)}</ul>")) + "</div>"
        body = html.escape(self.prose())
        return f"<!-- ad --><div{at}>" + r.choice((body, f"<p>{body}</p>", f'<a href="/buy">{body}</a>', f"<span>{self.words(1, 1)}</span> {body}")) + "</div>"

    def article(self) -> str:
        r = self.rng
        out = []
        if self.chance(0.8):
            title = self.marked(" ".join(self.prose().split()[:14]))
            out.append(f"<h1>{title}</h1>")
        for _ in range(r.choice((0, 1, 1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if kind < 0.75:
                out.append(self.p(self.prose()))
            elif kind < 0.83:
                out.append(f'<h{(n := r.randint(2, 4))}>{html.escape(self.words(1, 6))}</h{n}>')
            elif kind < 0.89:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{self.marked(self.prose())}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{self.p(self.prose())}</blockquote>")
            elif kind < 0.95:
                out.append(f'<figure><img src="a.jpg"><figcaption>{html.escape(self.words(3, 12))}</figcaption></figure>')
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{html.escape(self.words(1, 3))}</td><td>{html.escape(self.words(1, 3))}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<div>{self.marked(self.prose())}</div>")
            if self.chance(0.07):
                out.append(self.boiler(r.choice(("ad", "ad", "share", "side", "notice", "form"))))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        inner = self.article()
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        at = (self.name("main") if self.chance(0.6 if tag in ("article", "main") else 0.9) else "") + ' data-main="1"'
        main = f"<{tag}{at}>{inner}</{tag}>"
        main = f"<table><tr>{main}</tr></table>" if tag == "td" else main
        kinds = list(NAMES)
        before = [self.boiler(k) for k in ("notice", "header", "nav", "nav", "form", "ad", "share") if self.chance(0.4)]
        after = [self.boiler(k) for k in ("share", "side", "comments", "form", "ad", "side", "notice", "nav") if self.chance(0.35)]
        if self.chance(0.1):
            before += [self.boiler(r.choice(kinds)) for _ in range(3)]
        if self.chance(0.3):  # a wrapper around the article and what comes with it
            n = r.randint(0, len(after))
            main = f'<{(w := r.choice(("div", "main", "section")))}{r.choice(("", " id=wrap", self.name("main")))}>{main}{"".join(after[:n])}</{w}>'
            after = after[n:]
        body = "".join(before) + main + "".join(after) + (self.boiler("footer") if self.chance(0.8) else "")
        if self.chance(0.3):
            body = f'<div id="{r.choice(("page", "wrapper", "root", "container"))}">{body}</div>'
        head = f"<head><title>{html.escape(self.words(2, 6))}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
