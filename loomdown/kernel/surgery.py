"""Passes over the tree that make vendor markup fit for Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .chars import BLANK, BLOCKS, CELL_BLOCKS, EMPHASIS, FLEX, HEADINGS, HIDING, NON_TEXT, alphanumeric, clean, is_glyph
from .dom import Node, detach_all

STAT = re.compile(r"[0-9., kKMBms\u00b5h]*[0-9][0-9., kKMBms\u00b5h]*")
SIGNED = re.compile(r"[+-]?[0-9]+")
LARGEST_FLEX_ROW = 8
SHORT_PARAGRAPH = 60


def prune(root: Node) -> None:
    """Drops comments, namespaced, hidden and textless elements with all they hold."""
    stack = [root]
    while stack:
        node = stack.pop()
        for kid in list(node.kids):
            if kid.kind == "comment" or (kid.kind == "element" and invisible(kid)):
                kid.detach()
            elif kid.kids:
                stack.append(kid)


def invisible(node: Node) -> bool:
    if node.name in NON_TEXT or ":" in node.name:
        return True
    style = node.attrs.get("style", "").lower()
    return style != "" and any(h in style for h in HIDING)


def clean_texts(root: Node) -> None:
    """Invisible characters go, wide spaces become plain; link texts keep to one line."""
    for node in root.all():
        if node.kind == "text" and not node.text.isascii():
            node.text = clean(node.text)
    for link in root.named("a"):
        for node in link.walk():
            if node.kind == "text":
                node.text = node.text.replace("\n", " ").replace("\t", " ")


def settle_emphasis(root: Node) -> None:
    """Blank emphasis leaves at most a space, emphasis of up to three symbols only its content.

    What an element holds is read once, from the texts of the page in order: spaces that are left beside it change no verdict.
    """
    texts, ends = [], {}
    full, size = [0], [0]
    stack: list[tuple[Node, int]] = [(root, -1)]
    while stack:
        node, began = stack.pop()
        if began >= 0:
            ends[id(node)] = began, len(texts)
        elif node.kind == "text":
            texts.append(node.text)
            full.append(full[-1] + len(node.text) - sum(map(node.text.count, BLANK)))
            size.append(size[-1] + len(node.text))
        else:
            if node.name in EMPHASIS:
                stack.append((node, len(texts)))
            stack += [(k, -1) for k in reversed(node.kids)]
    for node in root.named(*EMPHASIS):
        low, high = ends[id(node)]
        many = full[high] - full[low]
        if many > 3:
            continue
        if many:
            core = "".join(t for t in texts[low:high] if t).strip(BLANK)
            if len(core) <= 3 and not any(c in BLANK or alphanumeric(c) for c in core):
                node.unwrap()
            continue
        if size[high] > size[low]:
            leave_space(node)
        node.detach()


def leave_space(node: Node) -> None:
    """A space in the text beside the node, before it if there is one, or else as a text of its own."""
    around, at = node.parent.kids, node.place()
    if at and around[at - 1].kind == "text":
        before = around[at - 1]
        before.text += "" if before.text.endswith(" ") else " "
    elif at + 1 < len(around) and around[at + 1].kind == "text":
        after = around[at + 1]
        after.text = after.text if after.text.startswith(" ") else " " + after.text
    else:
        node.put_before(Node.of_text(" "))


def demote_stats(root: Node) -> None:
    """A heading that only shows a figure becomes a bold paragraph."""
    for node in root.named(*HEADINGS):
        text = node.full_text().strip(BLANK)
        if 0 < len(text) <= 12 and STAT.fullmatch(text):
            node.put_before(Node.element("p", Node.element("strong", *list(node.kids))))
            node.detach()


def is_flex(node: Node) -> bool:
    return node.name == "div" and any(f in node.attrs.get("style", "") for f in FLEX)


def join_flex_rows(root: Node) -> None:
    """The divs of a small flex row give way to their content, each followed by a space."""
    found = []
    for node in root.all():
        if node.name == "div" and is_flex(node) and 2 <= sum(k.kind == "element" for k in node.kids) <= LARGEST_FLEX_ROW and not any(map(is_flex, node.above())):
            found += [d for d in node.below() if d.name == "div"]
    for div in deepest_first(found):
        if div.parent is not None and not any(n.name in CELL_BLOCKS for n in div.below()):
            div.put_before(*list(div.kids), Node.of_text(" "))
            div.detach()


def deepest_first(nodes: list[Node]) -> list[Node]:
    return sorted(nodes, key=lambda n: -n.depth())


def flatten_tables(root: Node) -> None:
    """Layout tables become paragraphs and blocks; data tables stay."""
    for table in deepest_first(root.named("table")):
        if table.parent is None:
            continue
        if not table.full_text().strip(BLANK):
            table.detach()
        elif not is_data(table):
            table.put_before(*compacted([block for row in rows_of(table) for block in row_blocks(row)]))
            table.detach()


def within(table: Node) -> Iterator[Node]:
    """The nodes below that belong to no table further in."""
    stack = list(reversed(table.kids))
    while stack:
        node = stack.pop()
        yield node
        if node.kids and node.name != "table":
            stack += node.kids[::-1]


def rows_of(table: Node) -> list[Node]:
    return [n for n in within(table) if n.name == "tr"]


def cells_of(row: Node) -> list[Node]:
    return [k for k in row.kids if k.name in ("td", "th")]


def is_data(table: Node) -> bool:
    if table.attrs.get("role", "").strip(BLANK).lower() in ("presentation", "none"):
        return False
    if any(n.name in ("thead", "caption") for n in within(table)):
        return True
    if any(n.name == "table" for n in table.below()):
        return False
    rows = rows_of(table)
    sizes = {len(cells_of(r)) for r in rows}
    many = len(rows) > 1
    border = table.attrs.get("border", "")
    number = int(border) if SIGNED.fullmatch(border) and abs(int(border)) < 2**31 else None
    return many and len(sizes) == 1 and max(sizes) > 1 and (border != "" if number is None else number > 0)


def is_blank(node: Node) -> bool:
    return node.kind == "comment" or (node.kind == "text" and not node.text.strip(BLANK))


def has_break(node: Node) -> bool:
    return node.name == "br" or (bool(node.kids) and any(n.name == "br" for n in node.walk()))


def sort_cell(kids: list[Node]) -> tuple[str, list[Node]]:
    """What a cell's children are to its row: ("lines" | "inline" | "blocks", the nodes to move)."""
    full = [k for k in kids if not is_blank(k)]
    is_block = lambda n: n.name in CELL_BLOCKS
    if any(map(has_break, full)):
        return "lines", full
    if not any(map(is_block, full)):
        return "inline", with_gaps(kids)
    if len(full) == 1 and full[0].name in ("p", "div"):
        inner = [k for k in full[0].kids if not is_blank(k)]
        return ("blocks", inner) if any(map(is_block, inner)) else ("inline", list(full[0].kids))
    return "blocks", full


def with_gaps(kids: list[Node]) -> list[Node]:
    """The full nodes, with the first blank one between each two of them."""
    out: list[Node] = []
    for kid in kids:
        if not is_blank(kid) or (out and not is_blank(out[-1])):
            out.append(kid)
    while out and is_blank(out[-1]):
        out.pop()
    return out


def row_blocks(row: Node) -> list[Node]:
    """A row's content: its inline cells in one paragraph, other cells as blocks of their own."""
    out: list[Node] = []
    line: Node | None = None

    def end_line() -> None:
        nonlocal line
        if line is not None and line.full_text().strip(BLANK):
            out.append(line)
        line = None

    for cell in cells_of(row):
        kids = list(cell.kids)
        if all(map(is_blank, kids)):
            continue
        kind, nodes = sort_cell(kids)
        if kind == "inline":
            line = line or Node.element("p")
            if line.kids and not (line.kids[-1].kind == "text" and line.kids[-1].text[-1:] in BLANK):
                line.append(Node.of_text(" "))
            detach_all(nodes)
            for n in nodes:
                line.append(n)
            continue
        end_line()
        detach_all(nodes)
        out += nodes if kind == "blocks" else [Node.element("p", *nodes)]
    end_line()
    return out


def is_short(node: Node) -> bool:
    return node.name == "p" and not any(n.name in BLOCKS for n in node.below()) and not has_break(node) and 0 < len(node.full_text().strip(BLANK)) <= SHORT_PARAGRAPH


def compacted(blocks: list[Node]) -> list[Node]:
    """Rows that are all short paragraphs, as the lines of one."""
    if len(blocks) < 2 or not all(map(is_short, blocks)):
        return blocks
    group = Node.element("p")
    for i, block in enumerate(blocks):
        for node in ([Node.element("br")] if i else []) + list(block.kids):
            group.append(node)
    return [group]


def drop_empty_links(root: Node) -> None:
    for link in root.named("a"):
        text = link.full_text().strip(BLANK)
        if not text or is_glyph(text):
            link.detach()


#: In this order: later passes rely on earlier ones.
PASSES = (prune, clean_texts, settle_emphasis, demote_stats, join_flex_rows, flatten_tables, drop_empty_links)
