"""A small document tree over the standard library's HTML parser, and a safe subset of selectors."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close an open one of the same kind, as browsers do.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OPENS_BLOCK = frozenset("div p ul ol table section article h1 h2 h3 h4 h5 h6 blockquote pre form header footer main nav aside".split())
UNSAFE = re.compile(r":(?:has|contains|matches|nth-child|nth-last-child|nth-of-type|nth-last-of-type)\s*\(", re.I)
_SIMPLE = re.compile(
    r"\*|[A-Za-z][\w-]*|\.[\w-]+|#[\w-]+|\[\s*[\w:-]+\s*(?:[*^$]?=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]"
)


class Node:
    """An element with its children, which are elements and texts."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self):
        """All elements below this one in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack += reversed(item.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#root")

    def handle_starttag(self, tag, attrs):
        for closed in (_CLOSES.get(tag), {"p"} if tag in _OPENS_BLOCK else None):
            if closed and self.open.tag in closed and self.open.parent is not None:
                self.open = self.open.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def selector_problem(selector: str) -> str | None:
    """Why a selector is refused; null if it is fine."""
    text = selector.strip()
    if not text or len(text) > 256:
        return "length"
    if "\0" in text:
        return "null character"
    if UNSAFE.search(text):
        return "unsafe pseudo-class"
    if text in ("*", "html", "body *"):
        return "too broad"
    if len(text.split(",")) > 5:
        return "too many groups"
    if len(re.findall(r"[>+~ ]+", text)) > 8:
        return "too many combinators"
    if text.count("[") > 8:
        return "too many attribute tests"
    try:
        compile_selector(text)
    except ValueError as e:
        return str(e)
    return None


def compile_selector(selector: str) -> list[list[tuple[str, list[str]]]]:
    """Groups of steps (combinator, simple tests)."""
    groups = []
    for group in selector.split(","):
        steps: list[tuple[str, list[str]]] = []
        combinator, at, group = " ", 0, group.strip()
        if not group:
            raise ValueError("empty group")
        while at < len(group):
            if group[at].isspace() or group[at] == ">":
                gap = re.match(r"\s*>\s*|\s+", group[at:])
                combinator = ">" if ">" in gap.group() else " "
                at += gap.end()
                continue
            tests = []
            while m := _SIMPLE.match(group, at):
                tests.append(m.group())
                at = m.end()
            if not tests:
                raise ValueError("unsupported selector")
            steps.append((combinator, tests))
            combinator = ""
            if at < len(group) and not (group[at].isspace() or group[at] == ">"):
                raise ValueError("unsupported selector")
        groups.append(steps)
    return groups


def _passes(node: Node, tests: list[str]) -> bool:
    for test in tests:
        if test == "*":
            continue
        if test[0] == ".":
            if test[1:] not in node.attrs.get("class", "").split():
                return False
        elif test[0] == "#":
            if node.attrs.get("id") != test[1:]:
                return False
        elif test[0] == "[":
            m = re.match(r"\[\s*([\w:-]+)\s*(?:([*^$]?)=\s*(.*?)\s*)?\]$", test)
            name, kind, wanted = m.group(1), m.group(2), m.group(3)
            have = node.attrs.get(name)
            if have is None:
                return False
            if wanted is not None:
                wanted = wanted.strip("\"'")
                fits = {"": have == wanted, "*": wanted in have, "^": have.startswith(wanted), "$": have.endswith(wanted)}
                if not (wanted and fits[kind] or kind == "" and have == wanted):
                    return False
        elif node.tag != test.lower():
            return False
    return True


def _fits(node: Node, steps: list[tuple[str, list[str]]], at: int) -> bool:
    if not _passes(node, steps[at][1]):
        return False
    if at == 0:
        return True
    up = node.parent
    if steps[at][0] == ">":
        return up is not None and _fits(up, steps, at - 1)
    while up is not None:
        if _fits(up, steps, at - 1):
            return True
        up = up.parent
    return False


def select(node: Node, selector: str) -> list[Node]:
    """Elements below ``node`` that a selector fits, in document order."""
    groups = compile_selector(selector)
    return [n for n in node.walk() if any(_fits(n, g, len(g) - 1) for g in groups)]


def first(node: Node, selector: str) -> Node | None:
    groups = compile_selector(selector)
    return next((n for n in node.walk() if any(_fits(n, g, len(g) - 1) for g in groups)), None)
