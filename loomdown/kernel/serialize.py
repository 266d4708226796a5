"""Markdown blocks of a cleaned tree.

Nothing recurses: inline strings are built from the leaves up, and the block functions are generators that ask a small
loop for the blocks of their children, so that deeply nested layouts cost no Python stack.
"""

from __future__ import annotations

import re
import string
from collections.abc import Generator

from .chars import BLANK, BLOCKS, CELL_BLOCKS, HEADINGS, PARAGRAPHS, is_glyph, lines_of, one_line
from .dom import Node
from .surgery import cells_of, rows_of

# Patterns that must match, as in functions/text.py.
LINK = re.compile(r"\[([^\]\n]+)\]\([^)\n]*\)")
SPACES = re.compile(r"[ \t\n\r\u00a0]+")
SPECIAL = re.compile(r"([\\`*_\[\]])")
UNICODE = re.compile(r"\\u\{([0-9a-fA-F]+)\}|\\U([0-9a-fA-F]{8})|\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})")


def decode_escapes(text: str) -> str:
    r"""Literal \uXXXX, \u{X...} and \UXXXXXXXX as their characters; what names none stays as it is."""

    def one(m: re.Match) -> str:
        if m[3]:
            return chr(0x10000 + ((int(m[3], 16) & 0x3FF) << 10) + (int(m[4], 16) & 0x3FF))
        value = int(m[1] or m[2] or m[5], 16)
        return m[0] if value > 0x10FFFF or 0xD800 <= value < 0xE000 else chr(value)

    return UNICODE.sub(one, text) if "\\" in text else text


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", SPACES.sub(" ", decode_escapes(text)))


def visible_width(text: str) -> int:
    return len(LINK.sub(r"\1", text.strip(BLANK)))


def tidy(text: str) -> str:
    if "\n" in text:
        text = "\n".join(x.strip(BLANK) for x in lines_of(text))
    text = text.strip(BLANK)
    return "" if len(text) == 1 and text in string.punctuation else text


def emphasised(inner: str, mark: str) -> str:
    """Marks around the text; blanks at its ends stay outside, and no pair of marks spans a line end."""
    if "\n" in inner:
        return "\n".join(mark + x + mark if (x := line.strip(BLANK)) else "" for line in inner.split("\n"))
    core = inner.strip(BLANK)
    if not core:
        return ""
    edge = lambda c: " " if c in BLANK else ""
    return edge(inner[0]) + mark + core + mark + edge(inner[-1])


def link(node: Node, inner: str) -> str:
    label, href = one_line(inner), node.attrs.get("href", "")
    if not label or is_glyph(label):
        return ""
    if not href or any(c in BLANK or c in "<>" for c in href) or label.rstrip("/") == href.rstrip("/"):
        return label
    if "](" in label:
        label = one_line(node.full_text())
    return f"[{label}]({href})" if label else ""


class Serializer:
    def __init__(self, root: Node):
        self.root = root
        order = root.all()
        self.block_below: set[int] = set()  # nodes with a block element somewhere below
        for node in reversed(order):
            if node.parent is not None and (node.name in BLOCKS or id(node) in self.block_below):
                self.block_below.add(id(node.parent))
        levels = [HEADINGS.index(n.name) + 1 for n in order if n.name in HEADINGS and n.full_text().strip(BLANK)]
        self.shift = min(levels, default=7) - 1

    # Inline

    def inline(self, node: Node) -> str:
        if not node.kids:
            return self.render(node, "")
        done: dict[int, str] = {}
        for n in reversed(node.all()):
            done[id(n)] = self.render(n, "".join(done.pop(id(k)) for k in n.kids).replace("****", ""))
        return done[id(node)]

    def render(self, node: Node, inner: str) -> str:
        name = node.name
        if node.kind == "text":
            return escape(node.text)
        if node.kind != "element":
            return ""
        if name == "a":
            return link(node, inner)
        if name in ("strong", "b", "em", "i"):
            return emphasised(inner, "**" if name in ("strong", "b") else "*")
        if name == "code":
            code = node.full_text().strip(BLANK)
            return f"`{code}`" if code else ""
        return "\n" if name == "br" else inner

    def inside(self, node: Node) -> str:
        return "".join(map(self.inline, node.kids)).replace("****", "")

    # Blocks

    def blocks(self) -> list[str]:
        body = next((n for n in self.root.walk() if n.name == "body"), self.root)
        return run(self.of_children(body))

    def of_children(self, node: Node) -> Generator:
        """Runs of inline children make one paragraph each."""
        out: list[str] = []
        run_: list[str] = []
        for kid in [*node.kids, None]:
            if kid is not None and kid.name not in BLOCKS and id(kid) not in self.block_below:
                run_.append(self.inline(kid))
                continue
            out += filter(None, [tidy("".join(run_))])
            run_ = []
            if kid is not None:
                out += yield self.of_block(kid)
        return out

    def of_block(self, node: Node) -> Generator:
        name = node.name
        if name in PARAGRAPHS:
            if any(k.name in BLOCKS for k in node.kids):
                return (yield self.of_children(node))
            text = tidy(self.inside(node))
        elif name in HEADINGS:
            text = self.inside(node).replace("\n", " ").strip(BLANK)
            level = min(6, max(1, HEADINGS.index(name) + 1 - self.shift))
            text = text and "#" * level + " " + text
        elif name == "hr":
            text = "---"
        elif name == "pre":
            text = "\n".join(x.rstrip(BLANK) for x in lines_of(node.full_text())).strip("\n")
            text = text and f"```\n{text}\n```"
        elif name == "blockquote":
            inner = yield self.of_children(node)
            text = "\n".join(f"> {x}" if x else ">" for x in lines_of("\n\n".join(inner))) if inner else ""
        elif name in ("ul", "ol"):
            text = yield self.of_list(node, 0)
        elif name == "table":
            text = self.of_table(node)
        elif name in ("html", "body") or id(node) in self.block_below:
            return (yield self.of_children(node))
        else:
            text = tidy(self.inline(node))
        return [text] if text else []

    def of_list(self, node: Node, depth: int) -> Generator:
        lines: list[str] = []
        for number, item in enumerate((k for k in node.kids if k.name == "li"), 1):
            parts, below = [], []
            for kid in item.kids:
                if kid.name in ("ul", "ol"):
                    below += lines_of((yield self.of_list(kid, depth + 1)))
                elif kid.name in CELL_BLOCKS:
                    parts.append(self.inside(kid).strip(BLANK))
                else:
                    parts.append(self.inline(kid))
            text = one_line("".join(parts))
            if text or any(k.name in ("ul", "ol") for k in item.kids):
                mark = f"{number}. " if node.name == "ol" else "- "
                lines += ["  " * depth + mark + text, *below]
        return "\n".join(lines)

    def of_table(self, table: Node) -> str:
        rows = [[one_line(self.inside(c)) for c in cells_of(r)] for r in rows_of(table)]
        width = max(map(len, rows), default=0)
        if len(rows) < 2 or not width:
            return ""
        rows = [r + [""] * (width - len(r)) for r in rows]  # short rows are padded, whichever row is the longest
        columns = list(zip(*rows, strict=True))
        columns = [c for c in columns if any(c)] or columns
        sizes = [max(3, *map(visible_width, c)) for c in columns]
        line = lambda cells: "|" + "".join(f" {c}{' ' * (n - visible_width(c))} |" for c, n in zip(cells, sizes, strict=True))
        head, *body = map(line, zip(*columns, strict=True))
        return "\n".join([head, "|" + "".join(f" {'-' * n} |" for n in sizes), *body])


def run(task: Generator):
    """The value of a generator whose yields are generators that it wants the values of."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value
