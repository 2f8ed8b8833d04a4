"""HTML pages as sequences of leaf text blocks with their tag paths: one scan, no document tree."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements whose content is not text, that have no content, and that do not end a block.
RAW = {"script", "style", "iframe", "noembed", "noframes", "xmp"}
TEXT_ONLY = {"title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label",
    "svg", "math", "object", "noscript", "canvas", "audio", "video",
}
#: Block tags that end an open p.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that a new one of the same kind closes, up to the container that bounds the search.
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements whose own kinds of elements are parts of a line, and in which a trailing / ends any element.
FOREIGN = {"svg", "math"}
#: Elements of a path that a block carries from either end; what stands between them is open but tells nothing.
FAR = 24
KNOWN = RAW | TEXT_ONLY | VOID | INLINE | ENDS_P | set(SELF_CLOSING)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


_marks: dict[tuple[str, str], tuple[str, ...]] = {}


def tag_marks(name: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    if not attributes or attributes.isspace():
        return (name,)
    key = (name, attributes) if len(attributes) < 200 else None
    if key in _marks:
        return _marks[key]
    out = [name]
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append("!hidden")
        elif kind != "style":
            out += [f"{'.' if kind == 'class' else '#' if kind == 'id' else '@'}{w}" for w in WORDS.findall(value)]
    got = tuple(out)
    if key and len(_marks) < 100_000:
        _marks[key] = got
    return got


def blocks(page: str | None) -> list[Block]:
    """The leaf text blocks of a page in order. Unclosed and misnested tags are taken as browsers mostly do."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements
    outer: list[tuple[str, ...]] = []  # marks of the open elements that are no part of a line
    opened: Counter = Counter()  # open elements by name
    foreign = 0
    words: list[str] = []
    linked = deep = 0  # characters inside links; how many a are open
    path: tuple = ()
    stale = True

    def flush() -> None:
        nonlocal words, linked, path, stale
        if words:
            text = " ".join("".join(words).split())
            if text:
                if stale:
                    path, stale = near(), False
                out.append(Block(path, text, linked))
            words = []
        linked = 0

    def near() -> tuple:
        return tuple(outer) if len(outer) <= 2 * FAR else (*outer[:FAR], *outer[-FAR:])

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        words.append(text)
        if deep:
            linked += len(text)

    def push(name: str, marks: tuple[str, ...]) -> None:
        nonlocal foreign
        stack.append((name, marks))
        opened[name] += 1
        foreign += name in FOREIGN
        if name not in INLINE:
            outer.append(marks)

    def close(i: int, only: bool = False) -> None:
        """The element at i ends, with all inside it (or only itself, an element of a line)."""
        nonlocal foreign, stale
        gone = stack[i : i + 1] if only else stack[i:]
        del stack[i : i + len(gone)]
        for name, _ in gone:
            opened[name] -= 1
            foreign -= name in FOREIGN
        blocks_gone = sum(name not in INLINE for name, _ in gone)
        if blocks_gone:
            del outer[len(outer) - blocks_gone :]
        stale = True

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if foreign and name not in KNOWN:
            continue
        if m[1] or m[4]:  # an end tag
            if name not in INLINE:
                flush()
            elif name == "a":
                deep = 0
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i, only=name in INLINE and any(n not in INLINE for n, _ in stack[i + 1 :]))
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW or name in TEXT_ONLY:
            if foreign and attributes.endswith("/"):
                continue
            flush() if name not in INLINE else None
            ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if name in TEXT_ONLY:
                inner = html.unescape(page[at : ends.start() if ends else size])
                text = " ".join(inner.split())
                if text:
                    out.append(Block((*near(), tag_marks(name, attributes)), text, 0))
            at = ends.end() if ends else size
            continue
        if name in INLINE:
            if name == "a":
                deep = 1
            if name not in VOID and not attributes.endswith("/"):
                push(name, (name,))
            continue
        flush()
        stale = True
        if name in VOID:
            continue
        if name in ENDS_P:
            for i in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif name in SELF_CLOSING:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in SELF_CLOSING[name]:
                    break
        push(name, tag_marks(name, attributes))
    flush()
    return out
