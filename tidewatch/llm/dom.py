"""Web pages as arrays of nodes and text runs: a tolerant reading of HTML without recursion."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# The element names that the HTML standard gives these roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is never shown as text of the page.
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math object select datalist canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph when they begin.
ENDS_P = BLOCK - {"body", "button", "caption", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An element ends open ones of the first kind, up to the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag does not reach out of these.
SCOPE = frozenset("table td th caption".split())
#: Loose text in these stands in a node of its own.
CONTAINER = frozenset("#page article aside blockquote center details dialog div fieldset figure footer form header main nav search section td".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARK = "data-y"  # set on pages made for training only


@dataclass
class Page:
    """Node k has ``parent[k] < k``, or -1; nodes of a subtree are numbered without gaps. Runs of text are in page order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    mark: list[str | None] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    run_node: list[int] = field(default_factory=list)
    run_text: list[str] = field(default_factory=list)
    run_link: list[bool] = field(default_factory=list)
    #: The run begins a new block.
    run_new: list[bool] = field(default_factory=list)

    def add(self, tag: str, parent: int, tokens: tuple[str, ...] = (), mark: str | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.mark.append(mark)
        self.controls.append(0)
        return len(self.tag) - 1


def _about(attributes: str) -> tuple[tuple[str, ...], str | None]:
    """Words of class, id and role, and the training mark."""
    words: list[str] = []
    mark = None
    for m in _ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        if name in ("class", "id", "role"):
            value = html.unescape(m.group(2) or m.group(3) or m.group(4) or "")
            words += [w.lower() for w in _WORD.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and "true" in m.group(0)) or (name == "style" and _HIDDEN.search(m.group(0))):
            words.append("hidden")
        elif name == MARK:
            mark = m.group(2)
    return tuple(words), mark


def read(text: str) -> Page:
    """The nodes and text runs of a page. Node 0 stands for the page and its body, whether there are tags for them or not."""
    page = Page()
    page.add("#page", -1)
    # open elements: (tag, node or that of the nearest node around it)
    stack: list[tuple[str, int]] = [("#page", 0)]
    count: dict[str, int] = {}
    unseen = links = 0
    fresh = True  # the next run begins a block
    loose = -1  # the node of the loose text at hand
    at, size, last = 0, len(text), text.rfind(">")

    def leave(k: int) -> None:
        """Close the elements from place k of the stack on."""
        nonlocal unseen, links
        for tag, _ in stack[k:]:
            count[tag] -= 1
            unseen -= tag in UNSEEN
            links -= tag == "a"
        del stack[k:]

    def find(kinds: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in kinds:
                return k
            if stack[k][0] in within:
                break
        return 0

    def say(piece: str) -> None:
        nonlocal fresh, loose
        if unseen or not piece:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if not piece.strip():
            if page.run_text and not fresh:
                page.run_text[-1] += " "  # white space between inline elements
            return
        tag, node = stack[-1]
        if page.tag[node] in CONTAINER:
            if loose < 0 or page.parent[loose] != node:
                loose = page.add("#text", node)
            node = loose
        page.run_node.append(node)
        page.run_text.append(piece)
        page.run_link.append(links > 0)
        page.run_new.append(fresh)
        fresh = False

    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            rest = text[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest) if at + len(rest) > last else None
            say(rest[: cut.start()] if cut else rest)  # a tag that the end of the page cuts off is no text
            break
        if m.start() > at:
            say(text[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag, ends = m.group(2).lower(), bool(m.group(1))
        block = tag in BLOCK
        if block or tag == "br":
            fresh, loose = True, -1
        if ends:
            if tag in HEADINGS:
                k = find(HEADINGS, SCOPE)  # any of them ends the open one
                if k:
                    leave(k)
            elif count.get(tag, 0):
                if block:
                    k = find({tag}, SCOPE if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"table"} - {tag})
                    if k:
                        leave(k)
                else:
                    k = find({tag}, SCOPE)
                    if k and (k == len(stack) - 1 or tag in UNSEEN):
                        leave(k)
                    elif k:  # only this element ends, blocks within it go on
                        count[tag] -= 1
                        links -= tag == "a"
                        del stack[k]
            continue
        attributes = m.group(3)
        if tag in VOID:
            if tag == "input":
                page.controls[stack[-1][1]] += 1
            continue
        if block or tag == "body":
            if count.get("p", 0) and tag in ENDS_P:
                k = find({"p"}, SCOPE | {"button"})
                if k:
                    leave(k)
            if tag in ENDS:
                k = find(*ENDS[tag])
                if k:
                    leave(k)
            if tag in HEADINGS and stack[-1][0] in HEADINGS:
                leave(len(stack) - 1)
        elif tag == "a" and count.get("a", 0):
            k = find({"a"}, SCOPE)
            if k:
                count["a"] -= 1
                links -= 1
                del stack[k]
        around = stack[-1][1]
        node = around
        if tag not in UNSEEN and not unseen:
            tokens, mark = _about(attributes) if attributes and not attributes.isspace() else ((), None)
            if tag in ("html", "body"):
                page.mark[0] = mark or page.mark[0]
            elif block or tokens or mark is not None:
                node = page.add(tag, around, tokens, mark)
                loose = -1
            if tag == "button":
                page.controls[node] += 1
        elif tag in ("select", "textarea"):
            page.controls[around] += 1
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        stack.append((tag, node))
        count[tag] = count.get(tag, 0) + 1
        unseen += tag in UNSEEN
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            leave(len(stack) - 1)
            if end is None:
                break
            close = text.find(">", end.end())
            at = size if close < 0 else close + 1
    return page


def joined(page: Page, keep: list[bool]) -> str:
    """The kept runs: white space inside a block becomes one space, and so do the borders of blocks."""
    out: list[str] = []
    new = False
    for node, text, begins in zip(page.run_node, page.run_text, page.run_new, strict=True):
        new |= begins
        if keep[node]:
            out.append(" " + text if new else text)
            new = False
    return " ".join("".join(out).split())
