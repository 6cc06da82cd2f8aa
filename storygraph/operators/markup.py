"""The per-page helper of the extraction jobs: pick strings out of one HTML text.

Only picking happens here; what the strings mean is decided in column expressions.
Selectors know tag, ``#id``, ``.class``, descendant and child steps, and comma lists.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without content, and start tags that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
# A start tag on the left ends an open element on the right, up to the given containers.
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object"})


@dataclass
class Page:
    """Elements in document order; ``last`` is the last element inside each one.

    ``text_from`` and ``text_to`` bound the text nodes inside an element, at any depth.
    """

    tag: list[str] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    text_from: list[int] = field(default_factory=list)
    text_to: list[int] = field(default_factory=list)
    text_owner: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[int] = []
        self.fresh_text = True

    def _pop_to(self, wanted: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        tags = self.page.tag
        for depth in range(len(self.stack) - 1, -1, -1):
            if tags[self.stack[depth]] in wanted:
                self._cut(depth)
                return
            if tags[self.stack[depth]] in scope:
                return

    def _cut(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.page.last[node] = len(self.page.tag) - 1
            self.page.text_to[node] = len(self.page.text)
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._pop_to({"p"}, P_SCOPE)
        if tag in ENDS_SIBLING:
            self._pop_to(*ENDS_SIBLING[tag])
        page = self.page
        page.tag.append(tag)
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        page.attrs.append(known)
        page.parent.append(self.stack[-1] if self.stack else -1)
        page.last.append(len(page.tag) - 1)
        page.text_from.append(len(page.text))
        page.text_to.append(len(page.text))
        if tag not in VOID:
            self.stack.append(len(page.tag) - 1)
        self.fresh_text = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._pop_to({tag}, frozenset())
        self.fresh_text = True

    def handle_comment(self, data):
        self.fresh_text = True

    def handle_data(self, data):
        if not self.stack:
            return
        page, owner = self.page, self.stack[-1]
        if self.fresh_text or page.text_owner[-1] != owner:
            page.text_owner.append(owner)
            page.text.append(data)
        else:
            page.text[-1] += data
        self.fresh_text = False


def read_page(html: str) -> Page:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._cut(0)
    return reader.page


STEP = re.compile(r"(>)|([a-zA-Z*][\w-]*|(?=[.#]))((?:[.#][\w-]+)*)")


def compile_selector(text: str) -> list[list[tuple[bool, str, str, frozenset[str]]]]:
    """Comma list of steps from the innermost outwards: (child of the next, tag, id, classes)."""
    out = []
    for alternative in text.split(","):
        steps, child = [], False
        for arrow, tag, rest in STEP.findall(alternative.strip()):
            if arrow:
                child = True
                continue
            marks = re.findall(r"([.#])([\w-]+)", rest)
            steps.append(
                (child, "" if tag == "*" else tag, "".join(m for k, m in marks if k == "#"), frozenset(m for k, m in marks if k == "."))
            )
            child = False
        out.append(steps[::-1])
    return out


Selector = list[list[tuple[bool, str, str, frozenset[str]]]]


@dataclass(frozen=True)
class State:
    """One step of a selector: the element it stands for, and the step around it (-1 for the outermost)."""

    tag: str
    ident: str
    classes: frozenset[str]
    outer: int
    child: bool
    ends: tuple[str, ...]

    def fits(self, attrs: dict[str, str]) -> bool:
        return (not self.ident or attrs.get("id") == self.ident) and (not self.classes or self.classes <= set(attrs.get("class", "").split()))


class Matcher:
    """All selectors of a site as one automaton, run once over the elements of a page.

    A state holds, for each open element, where the chain of elements that led to it begins: of
    several chains the innermost beginning, as that one lies within every element that any
    other lies in. So one walk answers each selector below every element at once: an
    element matches below ``root`` if its chain begins there.
    """

    def __init__(self, selectors: dict[str, Selector]):
        self.names = list(selectors)
        self.by_tag: dict[str, list[int]] = {}
        self.states: list[State] = []
        for name, alternatives in selectors.items():
            for steps in alternatives:
                outer = -1
                for k in range(len(steps) - 1, -1, -1):
                    child, tag, ident, classes = steps[k]
                    self.by_tag.setdefault(tag, []).append(len(self.states))
                    self.states.append(State(tag, ident, classes, outer, child, (name,) if k == 0 else ()))
                    outer = len(self.states) - 1

    def run(self, page: Page) -> Matches:
        found: dict[str, dict[int, int]] = {name: {} for name in self.names}
        here: list[dict[int, int]] = []  # by element: states it is the last step of
        above: list[dict[int, int]] = []  # and those it or an element around it is
        none: dict[int, int] = {}
        any_tag = self.by_tag.get("", [])
        for node, tag in enumerate(page.tag):
            up = page.parent[node]
            parent, around = (here[up], above[up]) if up >= 0 else (none, none)
            own: dict[int, int] = {}
            for k in [*self.by_tag.get(tag, ()), *any_tag]:
                state = self.states[k]
                begin = node if state.outer < 0 else (parent if state.child else around).get(state.outer, -1)
                if begin >= 0 and state.fits(page.attrs[node]):
                    own[k] = begin
                    for name in state.ends:
                        found[name][node] = max(begin, found[name].get(node, -1))
            here.append(own or none)
            above.append({**around, **{k: max(b, around.get(k, -1)) for k, b in own.items()}} if own else around)
        return Matches(page, {name: (list(nodes), list(nodes.values())) for name, nodes in found.items()})


@dataclass(frozen=True)
class Matches:
    """What the selectors match on a page: elements in document order, and where the chain of each begins."""

    page: Page
    found: dict[str, tuple[list[int], list[int]]]

    def select(self, name: str, root: int = 0) -> list[int]:
        """Matching elements in document order, ``root`` itself included."""
        nodes, begins = self.found[name]
        if not root:
            return nodes
        a, b = bisect_left(nodes, root), bisect_right(nodes, self.page.last[root])
        return [n for n, begin in zip(nodes[a:b], begins[a:b], strict=True) if begin >= root]

    def pick(self, name: str, what: str, root: int = 0) -> list[str]:
        """Strings of the matching elements: ``@name`` attributes, own ``text`` nodes, or ``texts`` of all depths."""
        page, nodes = self.page, self.select(name, root)
        if what.startswith("@"):
            return [page.attrs[n][what[1:]] for n in nodes if what[1:] in page.attrs[n]]
        if what == "text":
            chosen = set(nodes)
            lo, hi = (page.text_from[root], page.text_to[root]) if root else (0, len(page.text))
            return [t for owner, t in zip(page.text_owner[lo:hi], page.text[lo:hi]) if owner in chosen]
        return [t for n in nodes for t in page.text[page.text_from[n] : page.text_to[n]]]


def select(page: Page, selector: Selector, root: int = 0) -> list[int]:
    """Elements that one selector matches."""
    return Matcher({"": selector}).run(page).select("", root)
