"""The tokens of an HTML document."""

from __future__ import annotations

import html
import re
from html.entities import html5

SPACE = "[ \\t\\n\\f\\r]"
_tag = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*)")
_plain_tag = re.compile(r"<(/?)([a-z][a-z0-9]*)>")
_attr = re.compile(rf"(?:{SPACE}|/)*([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:{SPACE}*=(?:{SPACE}*)(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*|(?=>))))?")
_tag_end = re.compile(rf"(?:{SPACE}|/)*?(/?)>")
_comment_end = re.compile(r"--!?>")
_reference = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)(=?)")
RAW = frozenset("style script xmp iframe noembed noframes noscript".split())
TEXT_ONLY = frozenset(("title", "textarea"))


def in_attribute(value: str) -> str:
    """Character references as attributes take them: a name without its semicolon must not run on."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#" or name.endswith(";"):
            return html.unescape("&" + name) + m[2] if name[0] == "#" or name in html5 else m[0]
        return html5[name] if name in html5 and not m[2] else m[0]

    return _reference.sub(one, value) if "&" in value else value


class Tokenizer:
    """Yields ("text", data), ("comment", data), ("doctype", data), ("start", name, attrs, closed) and ("end", name).

    `raw` is set by the tree builder to the name of an element whose content is text up to its end tag.
    """

    def __init__(self, source: str):
        self.source = source.replace("\r\n", "\n").replace("\r", "\n")
        self.at = 0
        self.raw: str | None = None

    def __iter__(self):
        return self

    def __next__(self) -> tuple:
        source, at = self.source, self.at
        if at >= len(source):
            raise StopIteration
        if self.raw:
            return self.raw_text()
        if source[at] != "<":
            end = source.find("<", at)
            self.at = end if end >= 0 else len(source)
            return "text", html.unescape(source[at : self.at])
        if plain := _plain_tag.match(source, at):
            self.at = plain.end()
            return ("end", plain[2]) if plain[1] else ("start", plain[2], {}, False)
        if source.startswith("<!--", at):
            return self.comment()
        following = source[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not _tag.match(source, at) and source[at + 2 : at + 3]):
            end = source.find(">", at)
            self.at = end + 1 if end >= 0 else len(source)
            data = source[at + 2 : end if end >= 0 else None]
            if following == "/" and not data:
                return "text", ""  # "</>" is nothing
            return ("doctype", data) if following == "!" and data[:7].lower() == "doctype" else ("comment", data)
        m = _tag.match(source, at)
        if not m:
            self.at = at + 1
            return "text", "<"
        return self.tag(m)

    def comment(self) -> tuple:
        source, at = self.source, self.at + 4
        if source.startswith(">", at) or source.startswith("->", at):
            self.at = source.index(">", at) + 1
            return "comment", ""
        m = _comment_end.search(source, at)
        self.at = m.end() if m else len(source)
        return "comment", source[at : m.start() if m else None]

    def tag(self, m: re.Match) -> tuple:
        source, at, attrs = self.source, m.end(), {}
        while not (end := _tag_end.match(source, at)):
            a = _attr.match(source, at)
            if not a or (a.end() < len(source) and source[a.end()] == "=" ) or a.end() == len(source):
                self.at = len(source)  # the document ends within a tag: the tag is dropped
                return "text", ""
            value = next((v for v in a.groups()[1:] if v is not None), "")
            attrs.setdefault(a[1].lower(), in_attribute(value))
            at = a.end()
        self.at = end.end()
        name = m[2].lower().replace("\0", "\ufffd")
        return ("end", name) if m[1] else ("start", name, attrs, bool(end[1]))

    def raw_text(self) -> tuple:
        m = re.compile(rf"</{re.escape(self.raw)}(?=[ \t\n\f\r/>])", re.I).search(self.source, self.at)
        end = m.start() if m else len(self.source)
        data = self.source[self.at : end]
        if self.raw in TEXT_ONLY:
            data = html.unescape(data)
        self.at, self.raw = end, None
        return "text", data
