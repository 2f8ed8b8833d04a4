"""Training pages for the block labeller: a seeded grammar of page layouts with made-up words and known main text."""

from __future__ import annotations

import random

_SYLLABLES = "an the re on ti er ha ou le des en qui pa ion sch ver be ung der ich os ci do mi la es ra que lo ta è é ñ ö ü ka mo zu vi sto bra nel fi".split()
_MENU = "home about news contact products services login register search help faq archive topics blog shop sitemap".split()
_SIDE = [
    ("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "navbar"), ("ul", "menu"), ("div", "navigation"), ("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "topbar"), ("aside", ""), ("aside", "sidebar"),
    ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "related-posts"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "ad-banner"), ("div", "banner"), ("div", "promo"), ("div", "sponsored"), ("aside", "ad"),
    ("div", "cookie-notice"), ("div", "notice"), ("div", "cookie"), ("div", "consent"), ("div", "cookie-banner"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("div", "gdpr"), ("div", "disclaimer"), ("p", "notice"), ("form", ""), ("form", "search"), ("form", "newsletter"),
    ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "share"), ("div", "social"), ("div", "breadcrumb"), ("nav", "breadcrumbs"), ("div", "pagination"), ("div", "tags"), ("div", "meta"), ("section", "notice"), ("aside", "notice"), ("section", "promo"),
]
_LOW = [
    ("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "comment"), ("div", "replies"), ("div", "reader-comments"), ("section", "discussion"), ("aside", "comments"),
    ("div", "related"), ("aside", "sidebar"), ("div", "newsletter"), ("form", "comment-form"), ("form", ""), ("div", "ad"), ("ul", "links"), ("ul", "comments"), ("div", "disqus"), ("div", "responses"),
]
_MAIN = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry-content"), ("section", "story"), ("div", "article-body"), ("div", "main"), ("div", "text"), ("div", "post-content"), ("div", "story-body")]


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int = 1, most: int = 24) -> str:
        w = [self.word() for _ in range(self.r.randint(least, most))]
        return " ".join([w[0].capitalize(), *w[1:]]) + self.r.choice([".", ".", ".", "!", "?", ""])

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def open(self, tag: str, name: str) -> str:
        r = self.r
        if not name:
            return f"<{tag}>"
        name = r.choice([name, name, name.replace("-", "_"), f"{name} {r.choice(['clearfix', 'wide', 'box', 'x1', 'col'])}", f"{name}-{r.randint(1, 9)}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">'

    def aside_part(self, tag: str, name: str) -> str:
        """Something that is not main text."""
        r, how = self.r, self.r.random()
        inner = ""
        if tag in ("ul", "ol"):
            inner = "".join(f"<li>{self.linked() if how < 0.6 else self.inner_p()}</li>" for _ in range(r.randint(2, 8)))
        elif tag == "form":
            inner = f"<label>{self.word()}</label><input type=text><p>{self.sentence()}</p><button>{self.word()}</button>" if how < 0.6 else f"{self.sentence()}<input><select><option>{self.word()}<option>{self.word()}</select>"
        elif tag == "p":
            inner = self.prose(2)
        elif how < 0.35:
            inner = "<ul>" + "".join(f"<li>{self.linked()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        elif how < 0.6:
            inner = "".join(f"<p>{self.prose(3)}</p>" for _ in range(r.randint(1, 4)))
        elif how < 0.85:
            inner = ("&copy; " if "foot" in tag + name or "copy" in name else "") + self.prose(2)
        else:
            inner = f"<h{(k := r.choice((1, 2, 3, 3)))}>{self.sentence(1, 5)}</h{k}><div>{self.prose(3)}</div><p>{self.linked() if r.random() < 0.5 else self.sentence()}</p>"
        return f"{self.open(tag, name)}{self.wrapped(inner) if tag != 'p' and self.r.random() < 0.15 else inner}</{tag}>"

    def wrapped(self, inner: str) -> str:
        """Inside some plain elements, as page builders nest them."""
        k = self.r.choice([1, 2, 3, 5, 8, 13])
        return "<div>" * k + inner + "</div>" * k

    def inner_p(self) -> str:
        return f"<b>{self.word()}</b>: {self.prose(2)}" if self.r.random() < 0.5 else f"<p>{self.prose(2)}</p>"

    def linked(self) -> str:
        return f'<a href="/{self.word()}">{self.r.choice([self.r.choice(_MENU), self.word(), self.sentence(1, 4)])}</a>'

    def main_part(self) -> str:
        r, how = self.r, self.r.random()
        text = self.prose(r.choice([1, 2, 6, 12]))
        if how < 0.55:
            return f"<p>{text}</p>"
        if how < 0.62:
            return f"<p><b>{text}<br>"
        if how < 0.68:
            return f"<h{(k := r.randint(2, 4))}>{self.sentence(1, 6)}</h{k}>"
        if how < 0.74:
            return f"<p>{self.sentence()} {self.linked()} <em>{self.word()}</em> {text}</p>"
        if how < 0.8:
            return "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if how < 0.85:
            return f"<blockquote><p>{text}</p></blockquote>"
        if how < 0.89:
            return "<table><tr>" + "".join(f"<td>{self.word()}</td>" for _ in range(r.randint(1, 6))) + "</tr></table>"
        if how < 0.93:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        if how < 0.96:
            return f"<pre>{text}</pre>"
        return f"<div>{text}</div>"

    def page(self) -> tuple[str, str, str]:
        """(before, main, after): markup around the main text; side parts inside it stand between \x00 and \x01."""
        r = self.r
        title = self.sentence(1, 9)
        before = f"<html><head><title>{title}</title></head><body>" if r.random() < 0.9 else ""
        wrap = r.random() < 0.3
        before += "<div id=wrapper>" * wrap + "".join(self.aside_part(*r.choice(_SIDE)) for _ in range(r.choice([0, 1, 2, 2, 3, 5])))
        kind = r.random()
        tag, name = ("div", self.word()) if kind < 0.1 else ("", "") if kind < 0.18 else r.choice(_MAIN) if kind < 0.6 else ("article", "")
        untold = not tag or (kind < 0.1)
        inner = f"<h1>{title if r.random() < 0.7 else self.sentence(1, 9)}</h1>" if r.random() < 0.85 else ""
        for _ in range(r.choice([2, 3, 5, 8, 14] if untold else [0, 1, 1, 2, 3, 5, 8, 14])):
            part = f"<p>{self.prose(9)} {self.prose(9)}</p>" if untold and r.random() < 0.7 else self.main_part()
            inner += self.wrapped(part) if r.random() < 0.08 else part
            if r.random() < 0.05:
                inner += f"\x00{self.aside_part(*r.choice([s for s in _SIDE if s[0] != 'p' or s[1]]))}\x01"
        if r.random() < 0.12:
            inner += f"\x00{self.aside_part(*r.choice([s for s in _LOW if 'comment' in s[1] or s[0] in ('footer', 'form')]))}\x01"
        if not inner:
            inner = f"<p>{self.prose()}</p>"
        if r.random() < 0.15:
            inner = self.wrapped(inner)
        after = "".join(self.aside_part(*r.choice(_LOW)) for _ in range(r.choice([0, 1, 1, 2, 3])))
        if r.random() < 0.6:
            after += self.aside_part("footer", r.choice(["", "site-footer", "footer"]))
        begin, end = (self.open(tag, name), f"</{tag}>") if tag else ("", "")
        m = not untold and tag != "main" and r.random() < 0.15
        return before + "<main>" * m + begin, inner, end + "</main>" * m + after + ("</div>" * wrap + "</body></html>" if r.random() < 0.9 else "")


def training_pages(n: int, seed: int = 3):
    """(blocks, labels) of n pages; side parts are told from main text by a mark that their words carry."""
    import numpy as np

    from quarry.llm.htmlblocks import blocks

    grammar, pages, labels = Grammar(seed), [], []
    for _ in range(n):
        before, inner, after = grammar.page()
        parts = inner.replace("\x01", "\x00").split("\x00")
        marked = before + "".join(p if k % 2 else p.replace(">", ">\x02") for k, p in enumerate(parts)) + after
        own = blocks(marked)
        label = np.array([("\x02" in b.text) for b in own], np.float32)
        for b in own:
            b.text = b.text.replace("\x02", "").strip()
        keep = [i for i, b in enumerate(own) if b.text]
        if keep:
            pages.append([own[i] for i in keep])
            labels.append(label[keep])
    return pages, labels
