"""From HTML text to Markdown blocks and to rows of nodes."""

from __future__ import annotations

import re
from itertools import groupby

from .chars import BLANK
from .dom import Node
from .html_tree import parse
from .serialize import LINK, Serializer, visible_width
from .surgery import PASSES
from .wrap import wrap

HEADING = re.compile(rf"[{BLANK}]*(#{{1,6}}) ")


def blocks(html: str) -> list[str]:
    """The blocks of a page, before the steps that look at several blocks."""
    root = parse(html)
    for step in PASSES:
        step(root)
    return Serializer(root).blocks()


def level(block: str) -> int | None:
    found = HEADING.match(block)
    return found and len(found[1])


def markdown(html: str, width: int = 80) -> str:
    """A page's Markdown in one value, for the scalar SQL function: the steps over blocks as in functions/markdown.py."""
    width = width if 40 <= width <= 240 else 80
    out = blocks(html)
    out = [b for b, after in zip(out, [*out[1:], ""], strict=True) if not (level(b) and level(after) and level(after) <= level(b))]
    ranks = {n: "#" * i for i, n in enumerate(sorted({level(b) for b in out} - {None}), 1)}
    if len(ranks) > 1:
        out = [ranks[level(b)] + b.lstrip("#") if level(b) else b for b in out]
    rows: list[str] = []
    for short, run in groupby(out, lambda b: bool(LINK.fullmatch(b.strip(BLANK))) and visible_width(b) <= 30):
        run = list(run)
        line = " · ".join(run)
        rows += [line] if short and len(run) > 1 and visible_width(line) <= width else run
    return wrap(re.sub(r"\n{3,}", "\n\n", "\n\n".join(rows)), width).lstrip("\n")


def nodes(html: str, names: frozenset[str] | None = None) -> list[tuple]:
    """(node_id, parent_id, last_desc, depth, ord, kind, name, attrs, text) of each node of the page as parsed, in document order.

    names: only elements of these; all others are read and numbered too.
    """
    order: list[Node] = []
    ups: list[int] = []
    stack = [(parse(html), -1, 0, 0)]
    places: list[tuple[int, int]] = []
    while stack:
        node, up, depth, place = stack.pop()
        i = len(order)
        order.append(node)
        ups.append(up)
        places.append((depth, place))
        if node.kids:
            depth += 1
            stack += [(kid, i, depth, k) for k, kid in zip(range(len(node.kids) - 1, -1, -1), reversed(node.kids))]
    last = list(range(len(order)))
    for i in range(len(order) - 1, 0, -1):
        if last[i] > last[ups[i]]:
            last[ups[i]] = last[i]
    return [
        (i, ups[i] if i else None, last[i], *places[i], n.kind, n.name or None, n.attrs, n.text if n.kind != "element" else None)
        for i, n in enumerate(order)
        if names is None or n.name in names
    ]
