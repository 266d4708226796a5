"""Character classes and element sets that the passes share."""

from __future__ import annotations

import regex

# The Unicode White_Space characters, those deleted from text, and those that become a plain space.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_CLASS = r"\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DELETED_CLASS = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0020}-\x{E007F}"
SPACED_CLASS = r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"

# Element names by role.
NON_TEXT = frozenset("head style script iframe img colgroup col figure picture source svg canvas video audio area map noscript".split())
EMPHASIS = frozenset("em i strong b u mark small".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CELL_BLOCKS = frozenset("p div table ul ol li pre blockquote hr".split()) | frozenset(HEADINGS)
BLOCKS = frozenset("p div ul ol hr pre blockquote table header footer section article main aside nav center".split()) | frozenset(HEADINGS)
PARAGRAPHS = frozenset("p div center header footer section article main aside nav form fieldset".split())
HIDING = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
FLEX = ("display: flex", "display:flex")


def python_class(java: str) -> str:
    """The class as Python's regular expressions write it."""
    return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: regex.escape(chr(int(m[1], 16)), special_only=True), java)


_deleted = regex.compile(f"[{python_class(DELETED_CLASS)}]+")
_spaced = regex.compile(f"[{python_class(SPACED_CLASS)}]")
_blanks = regex.compile(f"[{python_class(BLANK_CLASS)}]+")
_letter = regex.compile(r"[\p{Alphabetic}\p{N}]")


def clean(text: str) -> str:
    return text if text.isascii() else _spaced.sub(" ", _deleted.sub("", text))


def one_line(text: str) -> str:
    """Blank runs as one space, none at the ends."""
    return _blanks.sub(" ", text).strip(" ")


def alphanumeric(char: str) -> bool:
    return bool(_letter.match(char))


def is_glyph(text: str) -> bool:
    """A single character that is no letter or digit."""
    return len(text) == 1 and not alphanumeric(text)


def lines_of(text: str) -> list[str]:
    """Lines ended by \\n or \\r\\n; no empty one after the last end."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]
