"""A tolerant HTML tree on the standard parser, and what is asked of it.

Unclosed elements nest, an end tag closes up to its element, unknown end tags are ignored, void
elements hold nothing, the end of the file closes all. Text of scripts, styles, templates and
comments is not part of ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from html import escape
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Node:
    """An element. The length of its text and the number of each tag below it are kept until something below changes."""

    __slots__ = ("tag", "attrs", "children", "parent", "_length", "_tags")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self._length = self._tags = None

    def _measure(self) -> None:
        """Length and tags of this element and all below it that are not known, from the leaves up."""
        stack = [(self, False)]
        while stack:
            node, ready = stack.pop()
            if not ready:
                stack.append((node, True))
                stack += [(c, False) for c in node.children if isinstance(c, Node) and c._tags is None]
                continue
            sizes, tags = [], {}
            for c in node.children:
                if isinstance(c, str):
                    sizes.append(len(c.strip()))
                    continue
                if c.tag not in SILENT and c.tag != "#comment":
                    sizes.append(c._length)
                tags[c.tag] = tags.get(c.tag, 0) + 1
                for tag, n in c._tags.items():
                    tags[tag] = tags.get(tag, 0) + n
            said = [n for n in sizes if n]
            node._length, node._tags = sum(said) + max(len(said) - 1, 0), tags

    def changed(self) -> None:
        """Forgets what is kept here and above; an element that has nothing kept has nothing kept above."""
        node = self
        while node is not None and node._tags is not None:
            node._length = node._tags = None
            node = node.parent

    def rename(self, tag: str) -> None:
        self.changed()
        self.tag = tag

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def names(self) -> str:
        """Class and id, as one text."""
        return f"{self.get('class')} {self.get('id')}".strip()

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in SILENT and node.tag != "#comment":
                stack += reversed(node.children)

    def text(self, between: str = " ") -> str:
        """The visible strings without blanks at their ends, joined."""
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def length(self) -> int:
        """The length of ``text``."""
        if self._tags is None:
            self._measure()
        return self._length

    def count(self, *tags: str) -> int:
        """How many elements of these tags are below."""
        if self._tags is None:
            self._measure()
        return sum(self._tags.get(t, 0) for t in tags)

    def all(self, *tags: str) -> list[Node]:
        return [e for e in self.elements() if e.tag in tags] if self.count(*tags) else []

    def first(self, *tags: str) -> Node | None:
        return next((e for e in self.elements() if e.tag in tags), None) if self.count(*tags) else None

    def where(self, test: Callable[[Node], bool]) -> list[Node]:
        return [e for e in self.elements() if test(e)]

    def inside(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def attached(self, root: Node) -> bool:
        node = self
        while node is not None:
            if node is root:
                return True
            node = node.parent
        return False

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.changed()
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def add(self, child: Node | str, at: int | None = None) -> None:
        if isinstance(child, Node):
            child.remove()
            child.parent = self
        self.changed()
        self.children.insert(len(self.children) if at is None else at, child)

    def html(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(escape(node, quote=False))
            elif node.tag == "#comment":
                out.append(f"<!--{''.join(node.children)}-->")
            elif node.tag == "#root":
                stack += reversed(node.children)
            else:
                out.append("<" + node.tag + "".join(f' {k}="{escape(v or "")}"' for k, v in node.attrs.items()) + ">")
                if node.tag not in VOID:
                    stack.append((f"</{node.tag}>",))
                    stack += [(c,) if node.tag in SILENT and isinstance(c, str) else c for c in reversed(node.children)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.mark = mark  # what stands for an ampersand that begins no reference

    def plain(self, text: str) -> str:
        return text.replace(self.mark, "&") if self.mark else text

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {self.plain(k): self.plain(v) if v is not None else "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(self.plain(data))

    def handle_comment(self, data):
        node = Node("#comment", None, self.at)
        node.children.append(self.plain(data))
        self.at.children.append(node)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _marked(html: str) -> tuple[str, str]:
    """A page with a character that it lacks in place of each ampersand that begins no whole reference, and that character."""
    mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in html)
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], html), mark


def parse(html: str | None, ended: bool = False) -> Node:
    """The tree of a page; of none or of what cannot be read, an empty one.

    Like browsers, it reads some references (``&amp``) that no semicolon ends; with ``ended`` those stay as they are.
    """
    html, mark = _marked(html or "") if ended else (html, "")
    builder = _Builder(mark)
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


@cache
def matches(pattern: str) -> Callable[[Node], bool]:
    """A test of one of an element's classes or its id."""
    compiled = re.compile(pattern)
    return lambda e: any(compiled.search(c) for c in (*e.get("class").split(), e.get("id")) if c)


@cache
def classed(pattern: str) -> Callable[[Node], bool]:
    compiled = re.compile(pattern)
    return lambda e: any(compiled.search(c) for c in e.get("class").split())


_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _simple(selector: str) -> Callable[[Node], bool] | None:
    m = _SELECTOR.match(selector)
    if not m or not selector:
        return None
    tag, tests = m[1], []
    for cls, ident, attr, op, value in _PART.findall(m[2]):
        if cls:
            tests.append(lambda e, v=cls: v in e.get("class").split())
        elif ident:
            tests.append(lambda e, v=ident: e.get("id") == v)
        else:
            how = {"": lambda a, v: True, "=": lambda a, v: a == v, "*=": lambda a, v: v in a, "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "~=": lambda a, v: v in a.split()}[op]
            tests.append(lambda e, n=attr, h=how, v=value: n in e.attrs and h(e.get(n), v))
    return lambda e: (not tag or tag == "*" or e.tag == tag.lower()) and all(t(e) for t in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements by a selector: tags, classes, ids, attributes, descendants, commas; a faulty one finds none."""
    found: list[Node] = []
    for one in selector.split(","):
        steps = [_simple(s) for s in one.replace(">", " ").split()]
        if not steps or None in steps:
            continue
        for e in root.elements():
            if e in found or not steps[-1](e):
                continue
            node, rest = e.parent, steps[:-1]
            while node is not None and rest:
                if rest[-1](node):
                    rest = rest[:-1]
                node = node.parent
            if not rest:
                found.append(e)
    return found
