"""Line wrapping by visible width."""

from __future__ import annotations

import regex

from .chars import BLANK, BLANK_CLASS, python_class
from .serialize import visible_width

_blank = f"[{python_class(BLANK_CLASS)}]"
# The shapes of lines that are kept, of quote and list marks, and of tokens that a break must not split.
REFERENCE = regex.compile(rf"\[[^\]]+\]:{_blank}")
MARKS = regex.compile(rf"(?P<indent> *)(?P<quote>(?:[> ]*>[> ]*)?)(?P<item>(?:(?:[-*+]|\p{{Nd}}+\.){_blank}+)?)")
TOKEN = regex.compile(rf"(?:!?\[(?:\\.|[^\]])*\]\((?:\\.|[^)])*\)|`[^`]*`|[^{_blank[1:]})+")
FENCES = ("```", "~~~")


def wrap(text: str, width: int) -> str:
    """Lines of fences and what stands between them, indented code, and lines that mean something as a whole are kept."""
    lines = text.split("\n")
    inside = False
    for at, line in enumerate(lines):
        if line.startswith(FENCES):
            inside = not inside
        elif not inside and not line.startswith(("    ", "\t")) and not stands_alone(line.lstrip(BLANK)):
            lines[at] = fill(line, width)
    return "\n".join(lines)


def stands_alone(core: str) -> bool:
    """Blank lines, headings, table rows, reference definitions and thematic breaks."""
    return core[:1] in ("", "#", "|") or REFERENCE.match(core) is not None or is_break(core)


def is_break(core: str) -> bool:
    """Nothing but dashes, stars, underscores and spaces: three or more in a run, or a dash or star with a space after it."""
    run = core.rstrip(" ")
    return not set(core) - set("-*_ ") and ((len(run) > 2 and " " not in run) or (core[0] in "-*" and core[1:2] == " "))


def fill(line: str, width: int) -> str:
    """Takes as many tokens as fit for each row; further rows repeat the quote marks and stand under the item's text."""
    marks = MARKS.match(line)
    tokens = TOKEN.findall(line, marks.end())
    sizes = [visible_width(t) for t in tokens]
    rows: list[str] = []
    begin, prefix = 0, marks[0]
    while begin < len(tokens):
        end, taken = begin + 1, len(prefix) + sizes[begin]
        # A token wider than a row would not fit on the next one either.
        while end < len(tokens) and (taken + 1 + sizes[end] <= width or sizes[end] > width):
            taken += 1 + sizes[end]
            end += 1
        rows.append(prefix + " ".join(tokens[begin:end]))
        begin, prefix = end, marks["indent"] + marks["quote"] + " " * len(marks["item"])
    return "\n".join(rows) if rows else line
