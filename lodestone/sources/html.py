"""HTML to Markdown on the standard library's parser."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

MAX_CHARS = 1_000_000
_DROPPED = {"i", "script", "iframe", "style"}
_MEDIA = {"video", "source", "audio"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "figcaption", "form", "fieldset", "address", "dl", "dt", "dd", "body", "html", "ul", "ol", "table", "blockquote", "pre", "hr"}
#: Markdown that a page's own text holds: marks that a backslash guards, and words between double underscores.
_GUARDED = re.compile(r"\\(?=[!-/:-@\[-`{-~])")
_UNDERLINED = re.compile(r"(?<!\w)__(?=[^\s_])(.*?)(?<=[^\s_])__(?!\w)")


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def first(self, tag: str):
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag == tag:
                    return c
                if found := c.first(tag):
                    return found
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Node("root")]

    @staticmethod
    def node(tag, attrs) -> _Node:
        """Attributes as they are read, but for pictures that are spelled out in place."""
        own = {k: unescape(v or "").strip() for k, v in attrs}
        head, inline, _ = own.get("src", "").partition(";base64,")
        if inline and head.lower().startswith("data:"):
            own["src"] = ""
        return _Node(tag, own)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "tr", "td", "th", "dt", "dd", "option") and self.stack[-1].tag == tag:
            self.stack.pop()
        node = self.node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(self.node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        """Text as it is to appear: what is still an entity is read, and Markdown in it is taken at its word."""
        self.stack[-1].children.append(_UNDERLINED.sub(r"**\1**", _GUARDED.sub("", unescape(data))))


def _wrapped(inner: str, mark: str) -> str:
    core = inner.strip()
    if not core:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    return f"{lead and ' '}{mark}{core}{mark}{tail and ' '}"


def _inline(node: _Node, depth: int = 0, plain: bool = False) -> str:
    return "".join(re.sub(r"[ \t\r\n]+", " ", c) if isinstance(c, str) and not plain else c if isinstance(c, str) else _render(c, depth, plain) for c in node.children)


def _block(text: str) -> str:
    text = text.strip("\n ")
    return f"\n\n{text}\n\n" if text else ""


def _items(node: _Node, depth: int) -> str:
    start, out = node.attrs.get("start", "1"), []
    number = int(start) if start.isdigit() else 1
    for c in node.children:
        if not isinstance(c, _Node) or c.tag != "li":
            continue
        mark = f"{number}." if node.tag == "ol" else "-"
        number += 1
        body = re.sub(r"\n{2,}", "\n", _inline(c, depth + 1).strip())
        out.append(f"{mark} " + body.replace("\n", "\n" + " " * (len(mark) + 1)))
    return "\n".join(out)


def _table(node: _Node) -> str:
    rows: list[tuple[bool, list[str]]] = []

    def walk(n: _Node):
        for c in n.children:
            if isinstance(c, _Node):
                if c.tag == "tr":
                    cells = [x for x in c.children if isinstance(x, _Node) and x.tag in ("td", "th")]
                    rows.append((bool(cells) and all(x.tag == "th" for x in cells), [re.sub(r"\s+", " ", _inline(x)).strip().replace("|", "\\|") for x in cells]))
                else:
                    walk(c)

    walk(node)
    rows = [r for r in rows if r[1]]
    if not rows:
        return ""
    width = len(rows[0][1])
    line = lambda cells: "| " + " | ".join(cells) + " |"
    top = rows.pop(0)[1] if rows[0][0] or node.first("thead") else [""] * width
    return "\n".join([line(top), line(["---"] * width), *(line(cells) for _, cells in rows)])


def _render(node: _Node, depth: int = 0, plain: bool = False) -> str:
    tag = node.tag
    if tag in _DROPPED:
        return ""
    if tag in _MEDIA:
        child = node.first("source")
        src = node.attrs.get("src") or (child.attrs.get("src") if child else "")
        return f"[{src}]({src})" if src else ""
    if re.fullmatch(r"h[1-6]", tag):
        text = re.sub(r"\s+", " ", _inline(node)).strip()
        return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
    if tag in ("strong", "b"):
        return _wrapped(_inline(node, depth, plain), "**")
    if tag == "em":
        return _wrapped(_inline(node, depth, plain), "_")
    if tag in ("del", "s"):
        return _wrapped(_inline(node, depth, plain), "~~")
    if tag in ("code", "kbd", "samp") and not plain:
        return _wrapped(_inline(node, depth, True), "`")
    if tag == "pre":
        return f"\n\n```\n{_inline(node, depth, True).strip(chr(10))}\n```\n\n"
    if tag == "br":
        return "  \n" if not plain else "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "a":
        text, href = _inline(node, depth, plain), node.attrs.get("href", "")
        name, shown = node.attrs.get("title"), text.replace("\n", " ").strip()
        return f"[{shown}]({href}" + (f' "{name}"' if name else "") + ")" if href and shown else text
    if tag == "img":
        name = node.attrs.get("title")
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')}" + (f' "{name}"' if name else "") + ")"
    if tag in ("ul", "ol"):
        text = _items(node, depth)
        return f"\n{text}\n" if depth else _block(text)
    if tag == "table":
        return _block(_table(node))
    if tag == "blockquote":
        text = _inline(node, depth).strip()
        return _block("\n".join(f"> {x}".rstrip() for x in text.split("\n"))) if text else ""
    inner = _inline(node, depth, plain)
    return _block(inner) if tag in _BLOCKS else inner


def html_to_markdown(html: str | None) -> str:
    """Markdown of a page: empty for nothing and for what cannot be read, the page itself beyond ``MAX_CHARS``."""
    if not html:
        return ""
    if len(html) > MAX_CHARS:
        return html
    try:
        tree = _Tree()
        tree.feed(html)
        tree.close()
        return re.sub(r"\n{3,}", "\n\n", _render(tree.stack[0])).strip()
    except (ValueError, AssertionError, RecursionError):
        return ""
