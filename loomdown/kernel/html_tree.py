"""Tree construction for HTML documents, after the HTML standard's insertion modes.

Framesets are left out: their tags are ignored. Contents of `template` are parsed and then cut off.
"""

from __future__ import annotations

from .dom import Node
from .html_tokens import RAW, TEXT_ONLY, Tokenizer

words = lambda s: frozenset(s.split())
FORMATTING = words("a b big code em font i nobr s small strike strong tt u")
SPECIAL = words(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main "
    "marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td "
    "template textarea tfoot th thead title tr track ul wbr xmp"
)
HEADINGS = words("h1 h2 h3 h4 h5 h6")
CLOSING_P = words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
BUTTONISH = CLOSING_P - {"p"} | {"button", "listing", "pre"}
IN_HEAD = words("base basefont bgsound link meta noframes script style template title")
IMPLIED = words("dd dt li optgroup option p rb rp rt rtc")
SCOPE = words("applet caption html table td th marquee object template foreignObject desc annotation-xml")
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, words("html table template")
TABLE_PARTS = words("caption col colgroup tbody td tfoot th thead tr")
BREAKOUT = words(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var"
)
BLANKS = " \t\n\f\r"
MARK = None  # in the list of formatting elements


class Builder:
    def __init__(self, source: str):
        self.tokens = Tokenizer(source)
        self.document = Node("document")
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []
        self.mode, self.back = "initial", "in_body"
        self.head: Node | None = None
        self.form: Node | None = None
        self.templates: list[Node] = []
        self.foster = False
        self.held: list[str] = []  # text between parts of a table
        self.skip_newline = False

    def build(self) -> Node:
        process = self.process
        for token in self.tokens:
            if self.skip_newline:
                if token[0] == "text" and token[1]:
                    token = ("text", token[1].removeprefix("\n"))
                if token[0] != "text" or token[1]:
                    self.skip_newline = False
            process(token)
        process(("eof",))
        for node in self.templates:
            for kid in list(node.kids):
                kid.detach()
        return self.document

    def process(self, token: tuple) -> None:
        if token[0] == "text":
            if "\0" in token[1]:
                token = ("text", token[1].replace("\0", ""))
            if not token[1]:
                return
        if self.open and self.open[-1].foreign and token[0] in ("start", "end", "text", "comment") and self.in_foreign(token):
            return
        getattr(self, self.mode)(token)

    # Places in the tree

    def current(self) -> Node:
        return self.open[-1]

    def target(self) -> tuple[Node, Node | None]:
        """(parent, node to insert before): a table's stray content goes before the table."""
        top = self.current()
        if self.foster and top.name in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.open) - 1, -1, -1):
                node = self.open[i]
                if node.name == "template":
                    return node, None
                if node.name == "table":
                    return (node.parent, node) if node.parent is not None else (self.open[i - 1], None)
            return self.open[0], None
        return top, None

    def insert(self, node: Node, at: tuple[Node, Node | None] | None = None) -> Node:
        parent, before = at or self.target()
        if before is None:
            parent.append(node)
        else:
            before.put_before(node)
        return node

    def put_text(self, data: str) -> None:
        parent, before = self.target() if self.foster else (self.open[-1], None)
        kids = parent.kids
        i = before.place() if before is not None else len(kids)
        if i and kids[i - 1].kind == "text":
            kids[i - 1].text += data
        elif before is None:
            parent.take(Node("text", text=data))
        else:
            self.insert(Node.of_text(data), (parent, before))

    def push(self, name: str, attrs: dict | None = None) -> Node:
        node = Node("element", name, attrs)
        if self.foster:
            self.insert(node)
        else:
            self.open[-1].take(node)
        self.open.append(node)
        if name == "template":
            self.templates.append(node)
        return node

    def pop_to(self, *names: str) -> None:
        while self.open.pop().name not in names:
            pass

    def has(self, names, barrier=SCOPE) -> bool:
        names = (names,) if isinstance(names, str) else names
        for node in reversed(self.open):
            if node.name in names and not node.foreign:
                return True
            if node.name in barrier:
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        while self.current().name in IMPLIED and self.current().name != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.has("p", BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_to("p")

    # Formatting elements

    def remember(self, node: Node) -> None:
        """Keeps at most three equal elements after the last mark."""
        if not self.formatting or self.formatting[-1] is MARK:
            self.formatting.append(node)
            return
        since = len(self.formatting) - next((i for i, x in enumerate(reversed(self.formatting)) if x is MARK), len(self.formatting))
        same = [i for i in range(since, len(self.formatting)) if self.formatting[i].name == node.name and self.formatting[i].attrs == node.attrs]
        if len(same) >= 3:
            del self.formatting[same[0]]
        self.formatting.append(node)

    def reopen(self) -> None:
        entries = self.formatting
        if not entries or entries[-1] is MARK or entries[-1] is self.open[-1]:
            return
        i = len(entries)
        while i and entries[i - 1] is not MARK and not any(entries[i - 1] is n for n in self.open):
            i -= 1
        for k in range(i, len(entries)):
            entries[k] = self.push(entries[k].name, dict(entries[k].attrs))

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not MARK:
            pass

    @staticmethod
    def drop(items: list, node: Node) -> None:
        for i, x in enumerate(items):
            if x is node:
                del items[i]
                return

    @staticmethod
    def where(items: list, node: Node | None) -> int:
        return next((i for i, x in enumerate(items) if x is node), -1)

    def adopt(self, name: str) -> None:
        """The adoption agency, for an end tag of a formatting element."""
        top = self.open[-1]
        if top.name == name and self.formatting and self.formatting[-1] is top:
            self.open.pop()
            self.formatting.pop()
            return
        if top.name == name and self.where(self.formatting, top) < 0:
            self.open.pop()
            return
        for _ in range(8):
            entry = None
            for x in reversed(self.formatting):
                if x is MARK:
                    break
                if x.name == name:
                    entry = x
                    break
            if entry is None:
                self.other_end(name)
                return
            at = self.where(self.open, entry)
            if at < 0:
                self.drop(self.formatting, entry)
                return
            if not any(n is entry for n in self.in_scope()):
                return
            block = next((n for n in self.open[at + 1 :] if n.name in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.drop(self.formatting, entry)
                return
            ancestor, mark = self.open[at - 1], self.where(self.formatting, entry)
            last, i, turn = block, self.where(self.open, block), 0
            while True:
                turn += 1
                i -= 1
                node = self.open[i]
                if node is entry:
                    break
                if turn > 3:
                    k = self.where(self.formatting, node)
                    if k >= 0:
                        mark -= k < mark
                        del self.formatting[k]
                k = self.where(self.formatting, node)
                if k < 0:
                    del self.open[i]
                    continue
                copy = Node("element", node.name, dict(node.attrs))
                self.formatting[k] = self.open[i] = copy
                if last is block:
                    mark = k + 1
                copy.append(last)
                last = copy
            last.detach()
            if ancestor.name in ("table", "tbody", "tfoot", "thead", "tr"):
                foster, self.foster = self.foster, True
                saved, self.open = self.open, self.open[:at]
                place = self.target()
                self.open, self.foster = saved, foster
                self.insert(last, place)
            else:
                ancestor.append(last)
            copy = Node("element", entry.name, dict(entry.attrs))
            for kid in list(block.kids):
                copy.append(kid)
            block.append(copy)
            k = self.where(self.formatting, entry)
            del self.formatting[k]
            self.formatting.insert(mark - (k < mark), copy)
            self.drop(self.open, entry)
            self.open.insert(self.where(self.open, block) + 1, copy)

    def in_scope(self):
        for node in reversed(self.open):
            yield node
            if node.name in SCOPE:
                return

    def other_end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.name == name:
                self.imply_ends(name)
                del self.open[i:]
                return
            if node.name in SPECIAL:
                return

    # Before the body

    def initial(self, token: tuple) -> None:
        if token[0] == "comment":
            self.document.append(Node("comment", text=token[1]))
        elif token[0] == "doctype":
            self.document.append(Node("doctype", text=token[1]))
            self.mode = "before_html"
        elif token[0] != "text" or (token := ("text", token[1].lstrip(BLANKS)))[1]:
            self.mode = "before_html"
            self.process(token)

    def before_html(self, token: tuple) -> None:
        if token[0] == "comment":
            self.document.append(Node("comment", text=token[1]))
        elif token[0] == "start" and token[1] == "html":
            self.start_html(token[2])
        elif token[0] == "doctype" or (token[0] == "end" and token[1] not in ("head", "body", "html", "br")):
            pass
        elif token[0] != "text" or (token := ("text", token[1].lstrip(BLANKS)))[1]:
            self.start_html({})
            self.process(token)

    def start_html(self, attrs: dict) -> None:
        node = Node("element", "html", attrs)
        self.document.append(node)
        self.open.append(node)
        self.mode = "before_head"

    def before_head(self, token: tuple) -> None:
        if self.outside(token, ("head", "body", "html", "br")):
            return
        if token[0] == "text" and not (token := ("text", token[1].lstrip(BLANKS)))[1]:
            return
        self.head = self.push("head", token[2] if token[:2] == ("start", "head") else {})
        self.mode = "in_head"
        if token[:2] != ("start", "head"):
            self.process(token)

    def outside(self, token: tuple, ends: tuple) -> bool:
        """What the modes around the head take alike: comments, doctypes, a second html tag and stray end tags."""
        if token[0] == "comment":
            self.insert(Node("comment", text=token[1]))
        elif token[:2] == ("start", "html"):
            self.in_body(token)
        elif token[0] != "doctype" and not (token[0] == "end" and token[1] not in ends):
            return False
        return True

    def leading_blanks(self, token: tuple) -> tuple | None:
        """Puts the blanks that a text begins with; what is left."""
        if token[0] != "text":
            return token
        rest = token[1].lstrip(BLANKS)
        if len(rest) < len(token[1]):
            self.put_text(token[1][: len(token[1]) - len(rest)])
        return ("text", rest) if rest else None

    def raw(self, token: tuple) -> None:
        self.push(token[1], token[2])
        self.tokens.raw = token[1]
        self.back, self.mode = self.mode, "in_text"

    def in_text(self, token: tuple) -> None:
        if token[0] == "text":
            self.put_text(token[1])
            return
        self.open.pop()
        self.mode = self.back
        if token[0] != "end":
            self.process(token)

    def in_head(self, token: tuple) -> None:
        if not (token := self.leading_blanks(token)):
            return
        if token[0] == "start" and token[1] in IN_HEAD:
            if token[1] in RAW or token[1] in TEXT_ONLY:
                self.raw(token)
            elif token[1] == "template":
                self.push("template", token[2])
                self.formatting.append(MARK)
                self.mode = "in_body"
            else:
                self.push(token[1], token[2])
                self.open.pop()
        elif token[:2] == ("start", "noscript"):
            self.raw(token)
        elif token[:2] == ("end", "template"):
            self.end_template()
        elif token[:2] == ("end", "head"):
            self.open.pop()
            self.mode = "after_head"
        elif token[:2] != ("start", "head") and not self.outside(token, ("body", "html", "br")):
            self.open.pop()
            self.mode = "after_head"
            self.process(token)

    def end_template(self) -> None:
        if any(n.name == "template" for n in self.open):
            self.pop_to("template")
            self.clear_formatting()
            self.reset()

    def after_head(self, token: tuple) -> None:
        if not (token := self.leading_blanks(token)):
            return
        if token[:2] == ("start", "body"):
            self.push("body", token[2])
            self.mode = "in_body"
        elif token[0] == "start" and token[1] in IN_HEAD:
            self.open.append(self.head)
            self.in_head(token)
            self.drop(self.open, self.head)
        elif token[:2] == ("end", "template"):
            self.end_template()
        elif token[:2] not in (("start", "head"), ("start", "frameset")) and not self.outside(token, ("body", "html", "br")):
            self.push("body")
            self.mode = "in_body"
            self.process(token)

    # The body

    def in_body(self, token: tuple) -> None:
        kind = token[0]
        if kind == "text":
            self.reopen()
            self.put_text(token[1])
        elif kind == "comment":
            self.insert(Node("comment", text=token[1]))
        elif kind == "start":
            self.body_start(token[1], token[2], token[3], token)
        elif kind == "end":
            self.body_end(token[1], token)

    def body_start(self, name: str, attrs: dict, closed: bool, token: tuple) -> None:
        if name == "html" or (name == "body" and len(self.open) > 1 and self.open[1].name == "body"):
            node = self.open[0 if name == "html" else 1]
            node.attrs.update({k: v for k, v in attrs.items() if k not in node.attrs})
        elif name in IN_HEAD:
            self.in_head_from_body(token)
        elif name in CLOSING_P:
            self.close_p()
            self.push(name, attrs)
        elif name in HEADINGS:
            self.close_p()
            if self.current().name in HEADINGS:
                self.open.pop()
            self.push(name, attrs)
        elif name in ("pre", "listing"):
            self.close_p()
            self.push(name, attrs)
            self.skip_newline = True
        elif name == "form":
            if self.form is None:
                self.close_p()
                self.form = self.push(name, attrs)
        elif name in ("li", "dd", "dt"):
            same = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.name in same:
                    self.imply_ends(node.name)
                    self.pop_to(node.name)
                    break
                if node.name in SPECIAL and node.name not in ("address", "div", "p"):
                    break
            self.close_p()
            self.push(name, attrs)
        elif name == "plaintext":
            self.close_p()
            self.push(name, attrs)
            self.put_text(self.tokens.source[self.tokens.at :])
            self.tokens.at = len(self.tokens.source)
        elif name == "button":
            if self.has("button"):
                self.imply_ends()
                self.pop_to("button")
            self.reopen()
            self.push(name, attrs)
        elif name == "a":
            for x in reversed(self.formatting):
                if x is MARK:
                    break
                if x.name == "a":
                    self.adopt("a")
                    self.drop(self.formatting, x)
                    self.drop(self.open, x)
                    break
            self.reopen()
            self.remember(self.push(name, attrs))
        elif name in FORMATTING:
            self.reopen()
            if name == "nobr" and self.has("nobr"):
                self.adopt("nobr")
                self.reopen()
            self.remember(self.push(name, attrs))
        elif name in ("applet", "marquee", "object"):
            self.reopen()
            self.push(name, attrs)
            self.formatting.append(MARK)
        elif name == "table":
            # Documents without a doctype are read in quirks mode, where a table does not close a paragraph.
            if any(k.kind == "doctype" for k in self.document.kids):
                self.close_p()
            self.push(name, attrs)
            self.mode = "in_table"
        elif name in ("area", "br", "embed", "img", "image", "keygen", "wbr", "input"):
            self.reopen()
            self.push("img" if name == "image" else name, attrs)
            self.open.pop()
        elif name in ("param", "source", "track"):
            self.push(name, attrs)
            self.open.pop()
        elif name == "hr":
            self.close_p()
            self.push(name, attrs)
            self.open.pop()
        elif name == "textarea" or name in RAW:
            if name == "xmp":
                self.close_p()
                self.reopen()
            self.raw(token)
            self.skip_newline = name == "textarea"
        elif name == "select":
            self.reopen()
            self.push(name, attrs)
            self.mode = "in_select"
        elif name in ("optgroup", "option"):
            if self.current().name == "option":
                self.open.pop()
            self.reopen()
            self.push(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.imply_ends("rtc" if name in ("rp", "rt") else "")
            self.push(name, attrs)
        elif name in ("math", "svg"):
            self.reopen()
            self.push(name, attrs).foreign = True
            if closed:
                self.open.pop()
        elif name not in ("frame", "frameset", "head", "body") and name not in TABLE_PARTS:
            self.reopen()
            self.push(name, attrs)

    def in_head_from_body(self, token: tuple) -> None:
        mode = self.mode
        if token[1] == "template":
            self.push("template", token[2])
            self.formatting.append(MARK)
            self.mode = "in_body"
        elif token[1] in RAW or token[1] in TEXT_ONLY:
            self.raw(token)
            self.back = mode
        else:
            self.push(token[1], token[2])
            self.open.pop()

    def body_end(self, name: str, token: tuple) -> None:
        if name == "template":
            self.end_template()
        elif name in ("body", "html"):
            if self.has("body"):
                self.mode = "after_body"
                if name == "html":
                    self.process(token)
        elif name in BUTTONISH:
            if self.has(name):
                self.imply_ends()
                self.pop_to(name)
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and any(n is node for n in self.in_scope()):
                self.imply_ends()
                self.drop(self.open, node)
        elif name == "p":
            if not self.has("p", BUTTON_SCOPE):
                self.push("p")
            self.close_p()
        elif name in ("li", "dd", "dt"):
            if self.has(name, LIST_SCOPE if name == "li" else SCOPE):
                self.imply_ends(name)
                self.pop_to(name)
        elif name in HEADINGS:
            if self.has(HEADINGS):
                self.imply_ends()
                self.pop_to(*HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("applet", "marquee", "object"):
            if self.has(name):
                self.imply_ends()
                self.pop_to(name)
                self.clear_formatting()
        elif name == "br":
            self.body_start("br", {}, False, token)
        else:
            self.other_end(name)

    def after_body(self, token: tuple) -> None:
        if token[0] == "comment":
            self.open[0].append(Node("comment", text=token[1]))
        elif token[0] == "text" and not token[1].strip(BLANKS):
            self.in_body(token)
        elif token[0] not in ("doctype", "eof") and token[:2] != ("end", "html"):
            self.mode = "in_body"
            self.process(token)

    # Tables

    def in_table(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "text" and self.current().name in ("table", "tbody", "tfoot", "thead", "tr"):
            self.held, self.back, self.mode = [token[1]], self.mode, "in_table_text"
        elif kind == "comment":
            self.insert(Node("comment", text=name))
        elif kind == "start" and name in TABLE_PARTS:
            self.back_to("table")
            if name == "caption":
                self.formatting.append(MARK)
                self.push(name, token[2])
                self.mode = "in_caption"
            elif name in ("colgroup", "col"):
                self.push("colgroup", token[2] if name == "colgroup" else {})
                self.mode = "in_column_group"
            else:
                wraps = name not in ("tbody", "tfoot", "thead")
                self.push("tbody" if wraps else name, {} if wraps else token[2])
                self.mode = "in_table_body"
                if wraps:
                    self.process(token)
                return
            if name == "col":
                self.process(token)
        elif kind == "start" and name == "table":
            if self.has("table", TABLE_SCOPE):
                self.pop_to("table")
                self.reset()
                self.process(token)
        elif kind == "end" and name == "table":
            if self.has("table", TABLE_SCOPE):
                self.pop_to("table")
                self.reset()
        elif kind == "end" and (name in TABLE_PARTS or name in ("body", "html")):
            pass
        elif kind == "start" and name in ("style", "script", "template") or (kind, name) == ("end", "template"):
            self.in_body(token)
        elif kind == "start" and name == "input" and token[2].get("type", "").lower() == "hidden":
            self.push(name, token[2])
            self.open.pop()
        elif kind == "start" and name == "form":
            if self.form is None:
                self.form = self.push(name, token[2])
                self.open.pop()
        elif kind not in ("doctype", "eof"):
            self.foster = True
            self.in_body(token)
            self.foster = False

    def in_table_text(self, token: tuple) -> None:
        if token[0] == "text":
            self.held.append(token[1])
            return
        text = "".join(self.held)
        self.mode = self.back
        if text.strip(BLANKS):
            self.foster = True
            self.in_body(("text", text))
            self.foster = False
        else:
            self.put_text(text)
        self.process(token)

    def back_to(self, *names: str) -> None:
        while self.current().name not in (*names, "html", "template"):
            self.open.pop()

    def in_caption(self, token: tuple) -> None:
        starts = token[0] == "start" and token[1] in TABLE_PARTS
        if starts or token[:2] in (("end", "caption"), ("end", "table")):
            if self.has("caption", TABLE_SCOPE):
                self.imply_ends()
                self.pop_to("caption")
                self.clear_formatting()
                self.mode = "in_table"
                if token[:2] != ("end", "caption"):
                    self.process(token)
        elif not (token[0] == "end" and (token[1] in TABLE_PARTS or token[1] in ("body", "html"))):
            self.in_body(token)

    def in_column_group(self, token: tuple) -> None:
        if not (token := self.leading_blanks(token)):
            return
        if token[0] == "comment":
            self.insert(Node("comment", text=token[1]))
        elif token[:2] == ("start", "col"):
            self.push("col", token[2])
            self.open.pop()
        elif token[:2] == ("start", "html") or token[0] in ("doctype", "eof") or token[:2] == ("end", "col"):
            pass
        elif self.current().name == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            if token[:2] != ("end", "colgroup"):
                self.process(token)

    def in_table_body(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        parts = ("tbody", "tfoot", "thead")
        if kind == "start" and name in ("tr", "th", "td"):
            self.back_to(*parts)
            self.push("tr", token[2] if name == "tr" else {})
            self.mode = "in_row"
            if name != "tr":
                self.process(token)
        elif (kind == "end" and name in parts) or (kind == "start" and name in ("caption", "col", "colgroup", *parts)) or (kind, name) == ("end", "table"):
            if self.has(name if kind == "end" and name != "table" else parts, TABLE_SCOPE):
                self.back_to(*parts)
                self.open.pop()
                self.mode = "in_table"
                if kind == "start" or name == "table":
                    self.process(token)
        elif not (kind == "end" and name in TABLE_PARTS):
            self.in_table(token)

    def in_row(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "start" and name in ("th", "td"):
            self.back_to("tr")
            self.push(name, token[2])
            self.mode = "in_cell"
            self.formatting.append(MARK)
        elif (kind == "start" and name in TABLE_PARTS) or (kind == "end" and name in ("tr", "table", "tbody", "tfoot", "thead")):
            if self.has("tr", TABLE_SCOPE) and (kind == "start" or name in ("tr", "table") or self.has(name, TABLE_SCOPE)):
                self.back_to("tr")
                self.open.pop()
                self.mode = "in_table_body"
                if (kind, name) != ("end", "tr"):
                    self.process(token)
        elif not (kind == "end" and name in TABLE_PARTS):
            self.in_table(token)

    def in_cell(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "end" and name in ("td", "th"):
            if self.has(name, TABLE_SCOPE):
                self.imply_ends()
                self.pop_to(name)
                self.clear_formatting()
                self.mode = "in_row"
        elif (kind == "start" and name in TABLE_PARTS) or (kind == "end" and name in ("table", "tbody", "tfoot", "thead", "tr")):
            if self.has(("td", "th") if kind == "start" else name, TABLE_SCOPE):
                self.imply_ends()
                self.pop_to("td", "th")
                self.clear_formatting()
                self.mode = "in_row"
                self.process(token)
        elif not (kind == "end" and (name in TABLE_PARTS or name in ("body", "html"))):
            self.in_body(token)

    def in_select(self, token: tuple) -> None:
        kind, name = token[0], token[1] if len(token) > 1 else ""
        if kind == "text":
            self.put_text(name)
        elif kind == "comment":
            self.insert(Node("comment", text=name))
        elif kind == "start" and name in ("option", "optgroup", "hr"):
            if self.current().name == "option":
                self.open.pop()
            if name != "option" and self.current().name == "optgroup":
                self.open.pop()
            self.push(name, token[2])
            if name == "hr":
                self.open.pop()
        elif kind == "end" and name in ("option", "optgroup"):
            if name == "optgroup" and self.current().name == "option" and self.open[-2].name == "optgroup":
                self.open.pop()
            if self.current().name == name:
                self.open.pop()
        elif kind == "start" and name in ("script", "template"):
            self.in_head_from_body(token)
        elif (kind, name) in (("end", "select"), ("start", "select")):
            self.pop_to("select")
            self.reset()
        elif name in ("input", "keygen", "textarea", "caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and kind in ("start", "end"):
            if kind == "start" or self.has(name, TABLE_SCOPE):
                self.pop_to("select")
                self.reset()
                self.process(token)

    def reset(self) -> None:
        """The mode that the open elements call for."""
        modes = {"select": "in_select", "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "td": "in_cell", "th": "in_cell", "body": "in_body", "template": "in_body", "head": "in_head"}
        self.mode = next((modes[n.name] for n in reversed(self.open) if n.name in modes), "after_head" if self.head else "before_head")

    # Foreign content

    def in_foreign(self, token: tuple) -> bool:
        """Whether the token was taken as part of an svg or math element."""
        kind = token[0]
        if kind == "text":
            self.put_text(token[1])
        elif kind == "comment":
            self.insert(Node("comment", text=token[1]))
        elif kind == "start":
            name, attrs, closed = token[1:]
            if name in BREAKOUT or (name == "font" and {"color", "face", "size"} & attrs.keys()):
                while self.open[-1].foreign:
                    self.open.pop()
                return False
            if self.current().name in ("foreignobject", "desc", "title", "annotation-xml"):
                return False
            self.push(name, attrs).foreign = True
            if closed:
                self.open.pop()
        else:
            for i in range(len(self.open) - 1, 0, -1):
                if not self.open[i].foreign:
                    return False
                if self.open[i].name == token[1]:
                    del self.open[i:]
                    return True
            return False
        return True


def parse(source: str) -> Node:
    return Builder(source).build()
