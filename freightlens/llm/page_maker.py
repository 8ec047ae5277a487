"""Labelled pages to fit on: random layouts around random prose. data-label marks what is article text."""

from __future__ import annotations

import random

_SYLLABLES = "ka to ren shi mo ala ver int quo dre es ing tion ou el ma pra lin ü é ç ñ sch ß ti or and".split()
#: Words of class and id by what a part of the page is for.
NAMES = {
    "main": "content article main post entry story body text page-content post-body entry-content article-body main-content story-text",
    "nav": "nav menu navbar navigation main-menu top-nav breadcrumbs site-nav pagination tabs",
    "header": "header masthead site-header top-bar logo branding page-header",
    "footer": "footer site-footer bottom copyright legal colophon foot",
    "side": "sidebar side rail widget right-side widgets secondary left-rail",
    "ad": "ad ads advert advertisement sponsored promo banner ad-slot top-ad adsense promo-box",
    "notice": "cookie-notice consent cookie-banner notice alert gdpr popup modal overlay disclaimer",
    "form": "form login signup subscribe newsletter search-form contact register search",
    "comment": "comments comment-list responses replies discussion reader-comments disqus_thread comment-section",
    "share": "share social share-buttons follow-us social-links tools",
    "related": "related recommended more-stories popular trending similar-posts read-more",
    "plain": "wrap container row inner box col x1 layout grid outer",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.junk = self.r.random() < 0.15
        self.upper = self.r.random() < 0.08
        self.bare = self.r.random() < 0.06  # the article stands straight below the body

    def words(self, n: int) -> str:
        r, out, left = self.r, [], 0
        for _ in range(n):
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            if left == 0:
                w, left = w.capitalize(), r.randint(1, 18)
            left -= 1
            out.append(w + (r.choice(".,.?!") if left == 0 else "," if r.random() < 0.05 else "") + (r.choice(("***", "%%%", "&amp;&amp;", "!!")) if self.junk else ""))
        return " ".join(out).upper() if self.upper else " ".join(out)

    def some(self) -> int:
        return int(self.r.choice((1, 3, 8, 20, 60, 120)) * (0.5 + self.r.random()))

    def name(self, kind: str, chance: float = 0.9) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        value = r.choice(NAMES[kind]) + r.choice(("", "", "", f"-{r.randint(1, 9)}", " clearfix", " js"))
        return f' {r.choice(("class", "class", "id"))}="{value}"'

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{i}">{self.words(self.r.randint(1, 4))}</a></{item}>' for i in range(n))

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            w = text.split(" ")
            k = r.randrange(len(w))
            tag = r.choice(("b", "i", "em", "strong", 'a href="/x"', "span", "code"))
            w[k] = f"<{tag}>{w[k]}</{tag.split()[0]}>"
            text = " ".join(w)
        return text.replace(" ", " <br>", 1) if r.random() < 0.1 else text

    def block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.7:
            return f"<p>{self.inline(self.words(self.some()))}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.78:
            return f"<h{(d := r.randint(2, 4))}>{self.words(r.randint(1, 8))}</h{d}>"
        if k < 0.86:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.words(r.randint(1, 25)))}</li>" for _ in range(r.randint(1, 8))) + f"</{tag}>"
        if k < 0.9:
            return f"<blockquote><p>{self.words(self.some())}</p></blockquote>"
        if k < 0.93:
            return f"<pre>{self.words(r.randint(3, 30))}</pre>"
        if k < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(r.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 6))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.words(r.randint(2, 15))}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        parts = [self.block() for _ in range(r.choice((1, 1, 2, 4, 8, 16)))]
        if r.random() < 0.15:
            parts = [f"{self.inline(self.words(self.some()))}<br>" for _ in parts]
        inside = [k for k in ("ad", "share", "related", "form", "side", "notice") if r.random() < 0.12]
        for k in inside:
            parts.insert(r.randint(0, len(parts)), self.part(k))
        if r.random() < 0.7:
            h = f"<h1>{self.words(r.randint(1, 12))}</h1>"
            parts.insert(0, f"<header>{h}</header>" if r.random() < 0.2 else h)
        if r.random() < 0.15:
            parts.append(self.part("footer"))
        body, style = "".join(parts), r.random()
        if self.bare:
            return body if r.random() < 0.7 else self.inline(self.words(self.some())) + body
        if style < 0.35:
            return f'<article data-label="1"{self.name("main", 0.3)}>{body}</article>'
        if style < 0.55:
            return f'<main><{(t := r.choice(("article", "div", "section")))} data-label="1"{self.name("main", 0.5)}>{body}</{t}></main>'
        if style < 0.85:
            return f'<div data-label="1"{self.name("main")}>{body}</div>'
        if style < 0.93:
            return f'<div{self.name("plain")}><div data-label="1">{body}</div></div>'
        return f'<section data-label="1"{self.name("main", 0.7)}>{body}</section>'

    def part(self, kind: str) -> str:
        r, name = self.r, self.name(kind)
        prose = lambda: self.words(self.some())
        div = r.choice(("div", "div", "section"))
        if kind == "nav":
            tag = r.choice(("nav", "nav", "div"))
            body = f"<ul>{self.links(r.randint(2, 12))}</ul>" if r.random() < 0.7 else self.links(r.randint(2, 8), "span")
            out = f"<{tag}{name if tag == 'div' or r.random() < 0.3 else ''}>{body}</{tag}>"
        elif kind in ("header", "footer"):
            tag = r.choice((kind, kind, "div"))
            body = "".join(r.sample([f"<p>{self.words(r.randint(1, 20))}</p>", "&copy; " + self.words(r.randint(1, 20)), f'<a href="/">{self.words(2)}</a>', f"<ul>{self.links(r.randint(1, 6))}</ul>", f"<span>{self.words(3)}</span>"], r.randint(1, 3)))
            body = f"<h1>{self.words(3)}</h1>" + body if kind == "header" and r.random() < 0.3 else body
            out = f"<{tag}{name if tag == 'div' or r.random() < 0.4 else ''}>{body}</{tag}>"
        elif kind == "side":
            tag = r.choice(("aside", "aside", "div"))
            body = "".join(r.choice((f"<h3>{self.words(3)}</h3><ul>{self.links(r.randint(2, 8))}</ul>", f"<p>{prose()}</p>", f"<div{self.name('side')}>{prose()}</div>")) for _ in range(r.randint(1, 4)))
            out = f"<{tag}{name if tag == 'div' or r.random() < 0.5 else ''}>{body}</{tag}>"
        elif kind == "form":
            out = f"<form{self.name(kind, 0.5)}><label>{self.words(2)}</label><input name=q><p>{self.words(r.randint(1, 20))}</p><button>{self.words(1)}</button></form>"
            out = f"<div{name}>{out}</div>" if r.random() < 0.4 else out
        elif kind == "comment":
            one = lambda: f"<{r.choice(('div', 'li', 'article'))}{r.choice((' class=comment', ' class=reply', ''))}><b>{self.words(1)}</b><p>{prose()}</p></div>"
            out = f"<{div}{self.name(kind, 1)}><h3>{self.words(2)}</h3>{''.join(one() for _ in range(r.randint(1, 8)))}</{div}>"
        elif kind in ("share", "related"):
            out = f"<{div}{self.name(kind, 1)}>" + (f"<h3>{self.words(2)}</h3>" if r.random() < 0.5 else "") + f"<ul>{self.links(r.randint(2, 8))}</ul>" + (f"<p>{prose()}</p>" if r.random() < 0.3 else "") + f"</{div}>"
        else:
            body = prose() if r.random() < 0.6 else f"<p>{prose()}</p>" + (f'<a href="#">{self.words(2)}</a>' if r.random() < 0.5 else "")
            out = f"<{r.choice(('div', 'div', 'aside', 'section'))}{self.name(kind, 1)}>{body}"
            out += f"</{out[1:].split(' ')[0].split('>')[0]}>"
        cut = out.index(">") if " " not in out[: out.index(">")] else out.index(" ")
        return out[:cut] + ' data-label="0"' + out[cut:]

    def page(self) -> str:
        r = self.r
        before = [k for k, c in (("notice", 0.15), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.1), ("side", 0.15)) if r.random() < c]
        after = [k for k, c in (("share", 0.25), ("comment", 0.35), ("related", 0.25), ("ad", 0.2), ("side", 0.3), ("form", 0.15), ("nav", 0.1), ("footer", 0.75), ("notice", 0.1)) if r.random() < c]
        if r.random() < 0.3:
            r.shuffle(before)
        middle = self.article() if r.random() < 0.97 else ""
        inner = after[: r.randint(0, len(after))] if r.random() < 0.4 else []
        middle = middle + "".join(map(self.part, inner))
        if inner or r.random() < 0.3:
            middle = f"<div{self.name('plain', 0.7)}>{middle}</div>"
        head, foot = "".join(map(self.part, before)), "".join(map(self.part, after[len(inner) :]))
        if not self.bare:  # notices and adverts may stand straight below the body, too
            head = self.inline(self.words(r.randint(2, 20))) + head if r.random() < 0.06 else head
            foot += r.choice(("&copy; ", "")) + self.inline(self.words(r.randint(2, 20))) if r.random() < 0.1 else ""
        body = ' data-label="1"' if self.bare and middle else ""
        return f"<html><head><title>{self.words(4)}</title></head><body{body}>{head}{middle}{foot}" + r.choice(("</body></html>", ""))
