"""A page as a tree of elements, and selectors over it: by tag, id, beginning of id, class, attribute, and an element around."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Fixed values of HTML: elements without an end, and those that a start of the same kind (or of the second kind) ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDED_BY = {"li": {"li"}, "p": {"p", "div", "ul", "ol", "li", "table", "section", "h1", "h2", "h3", "h4", "h5", "h6"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements that keep what begins within them inside: an open li or p beyond them is not ended.
SCOPES = {"ul", "ol", "table", "div", "body", "html"}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list[Element | str] = field(default_factory=list)
    parent: Element | None = None

    def descendants(self) -> Iterator[Element]:
        """All elements below, in the order of their starts."""
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Element):
                    yield part
                    stack.append(iter(part.parts))
                    break
            else:
                stack.pop()

    def texts(self) -> Iterator[str]:
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Element):
                    stack.append(iter(part.parts))
                    break
                yield part
            else:
                stack.pop()

    def text(self) -> str:
        """All text below, its pieces and words parted by one blank."""
        return " ".join(" ".join(self.texts()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in SCOPES:
            if tag in ENDED_BY.get(node.tag, ()):
                self.at = node.parent
            node = node.parent
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        self.at.parts.append(child := Element(tag, values, [], self.at))
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


@dataclass(frozen=True)
class Selector:
    """What is given must hold; within: some element around must match that."""

    tag: str | None = None
    id: str | None = None
    id_start: str | None = None
    cls: str | None = None
    attr: tuple[str, str] | None = None
    within: Selector | None = None

    def matches(self, e: Element) -> bool:
        if self.tag not in (None, e.tag) or self.id is not None and e.attrs.get("id") != self.id:
            return False
        if self.id_start is not None and not e.attrs.get("id", "").startswith(self.id_start) or self.cls is not None and self.cls not in e.attrs.get("class", "").split():
            return False
        if self.attr is not None and e.attrs.get(self.attr[0]) != self.attr[1]:
            return False
        around = e.parent if self.within else None
        while around is not None and not self.within.matches(around):
            around = around.parent
        return self.within is None or around is not None


def select(root: Element, selector: Selector) -> Iterator[Element]:
    return (e for e in root.descendants() if selector.matches(e))


def first_text(root: Element, selector: Selector) -> str:
    """The text of the first element that matches; empty if there is none."""
    found = next(select(root, selector), None)
    return "" if found is None else found.text()
