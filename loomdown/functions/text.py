"""Column functions on strings: what the Markdown passes do to text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.chars import BLANK, BLANK_CLASS, CELL_BLOCKS, DELETED_CLASS, FLEX, HEADINGS, HIDING, NON_TEXT, SPACED_CLASS
from ..kernel.chars import BLOCKS as BLOCK_NAMES

# Patterns that both Java and RE2 read alike.
IE_CONDITIONAL = r"(?si)<!\[if[^\]]*\]>.*?<!\[endif\]>"
COMMENT = r"(?s)<!--.*?-->"
LINK = r"\[([^\]\n]+)\]\([^)\n]*\)"
LINK_ONLY = r"\A\[[^\]\n]+\]\([^)\n]*\)\z"
HEADING = rf"\A[{BLANK_CLASS}]*(#{{1,6}}) "
FENCE = r"\A(?:```|~~~)"
REFERENCE = rf"\A\[[^\]]+\]:[{BLANK_CLASS}]"
BREAK = r"\A(?:[-*] [-*_ ]*|[-*_]{3,} *)\z"
ITEM = rf"\A(?:[-*+]|\p{{Nd}}+\.)[{BLANK_CLASS}]+"
ESCAPES = r"\\u\{[0-9a-fA-F]+\}|\\U[0-9a-fA-F]{8}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|[^\\]+|\\"
# What a line break must not split: links and images, code, and all else that is not blank. Possessive, so that Java needs no stack for long tokens.
# A label or target ends at its first bracket that is not escaped, or else, with backslashes taken as they are, at the last that fits.
_to = lambda close: rf"(?:[^{close}\\]*+(?:\\[^\n][^{close}\\]*+)*+{close}|[^{close}]*+(?:(?<=\\){close}[^{close}]*+)*{close})"
TOKEN = rf"(?:!?\[{_to(chr(92) + ']')}\({_to(chr(92) + ')')}|`[^`]*+`|[^{BLANK_CLASS}])++"
MARKS = rf"\A( *)((?:[> ]*>[> ]*)?)((?:(?:[-*+]|\p{{Nd}}+\.)[{BLANK_CLASS}]+)?)"
# With a line end before it: a fence with all up to its end, or any other line.
FENCED_OR_LINE = r"\n(?:(?:```|~~~)[^\n]*+(?:\n(?!```|~~~)[^\n]*+)*+(?:\n[^\n]*+)?+|[^\n]*+)"
PUNCTUATION = r"\A[!-/:-@\[-`{-~]\z"


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ie_conditionals(html: Column) -> Column:
    return F.regexp_replace(html, IE_CONDITIONAL, "")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def clean_invisibles(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"[{DELETED_CLASS}]", ""), f"[{SPACED_CLASS}]", " ")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r\x{A0}]+", " "), r"([\\`*_\[\]])", r"\\$1")


def decode_unicode_escapes(text: Column) -> Column:
    r"""Literal \uXXXX, \u{X...} and \UXXXXXXXX, also as surrogate pairs, as their characters; what names none stays as it is."""

    def units(code: Column) -> Column:
        """The code units of a character, in hex."""
        over = code - 0x10000
        pair = F.concat(F.hex(F.shiftright(over, 10) + 0xD800), F.hex(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(pair)

    def one(piece: Column) -> Column:
        pair = F.length(piece) == 12
        digits = F.regexp_replace(piece, r"\A\\[uU]\{?0*|\}\z", "")
        code = F.conv(F.when(F.length(digits) <= 6, F.concat(F.lit("0"), digits)).otherwise(F.lit("110000")), 16, 10).cast("long")
        named = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return (
            F.when(~F.startswith(piece, F.lit("\\")) | (F.length(piece) == 1), piece)
            .when(pair & F.contains(F.substring(piece, 3, 10), F.lit("\\")), F.decode(F.unhex(F.concat(F.substring(piece, 3, 4), F.substring(piece, 9, 4))), "UTF-16BE"))
            .when(named, F.decode(F.unhex(units(code)), "UTF-16BE"))
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(text, F.lit(ESCAPES), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def escape_text(text: Column) -> Column:
    """Escapes for Markdown, of the text that its literal Unicode escapes stand for."""
    return escape_markdown(decode_unicode_escapes(text))


def is_blank(text: Column) -> Column:
    return trim_blanks(text) == ""


def ends_with_blank(text: Column) -> Column:
    """Whether nothing or a blank is at the end."""
    return (text == "") | text.rlike(rf"[{BLANK_CLASS}]\z")


def is_fence(line: Column) -> Column:
    return line.rlike(FENCE)


def is_reference(line: Column) -> Column:
    """A reference definition."""
    return F.ltrim(line, F.lit(BLANK)).rlike(REFERENCE)


def is_thematic_break(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANK)).rlike(BREAK)


def list_mark(line: Column) -> Column:
    """The mark at the start of a list item with the blanks after it, empty for other lines."""
    return F.regexp_extract(line, ITEM, 0)


def collapse_blank_runs(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def flatten_link_text(text: Column) -> Column:
    return F.translate(text, "\n\t", "  ")


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def one_line(text: Column) -> Column:
    return F.regexp_replace(trim_blanks(text), f"[{BLANK_CLASS}]+", " ")


def is_stat(text: Column) -> Column:
    return text.rlike("\\A[0-9., kKMBmsµh]+\\z") & text.rlike("[0-9]")


def is_glyph(text: Column) -> Column:
    return (F.length(text) == 1) & ~text.rlike(r"[\p{IsAlphabetic}\p{N}]")


def hides(style: Column) -> Column:
    low = F.lower(style)
    return F.coalesce(F.greatest(*(F.contains(low, F.lit(h)) for h in HIDING)), F.lit(False))


def is_flex(style: Column) -> Column:
    return F.coalesce(F.greatest(*(F.contains(style, F.lit(f)) for f in FLEX)), F.lit(False))


def is_namespaced(name: Column) -> Column:
    return F.instr(name, ":") > 0


def is_non_text(name: Column) -> Column:
    return name.isin(*sorted(NON_TEXT))


def is_block(name: Column) -> Column:
    return name.isin(*sorted(BLOCK_NAMES))


def is_cell_block(name: Column) -> Column:
    return name.isin(*sorted(CELL_BLOCKS))


def heading_level(name: Column) -> Column:
    """1 to 6 for h1 to h6, else null."""
    return F.when(name.isin(*HEADINGS), F.substring(name, 2, 1).cast("int"))


def heading_block(level: Column, shift: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level - shift))), F.lit(" "), text)


def block_level(block: Column) -> Column:
    """The level of a Markdown heading, else null."""
    marks = F.length(F.regexp_extract(block, HEADING, 1))
    return F.when(marks > 0, marks)


def visible_width(text: Column) -> Column:
    return F.length(F.regexp_replace(trim_blanks(text), LINK, "$1"))


def is_short_link(block: Column) -> Column:
    core = trim_blanks(block)
    return core.rlike(LINK_ONLY) & (visible_width(core) <= 30)


def tidy_inline(text: Column) -> Column:
    lines = F.array_join(F.transform(F.split(text, "\n"), trim_blanks), "\n")
    out = trim_blanks(lines)
    return F.when(out.rlike(PUNCTUATION), F.lit("")).otherwise(out)


def emphasis(text: Column, mark: str) -> Column:
    """A flat string in emphasis marks, with the blanks at its ends outside and each line on its own."""
    core = trim_blanks(text)
    edge = lambda at: F.when(text.rlike(at), F.lit(" ")).otherwise(F.lit(""))
    flat = F.when(core == "", F.lit("")).otherwise(F.concat(edge(rf"\A[{BLANK_CLASS}]"), F.lit(mark), core, F.lit(mark), edge(rf"[{BLANK_CLASS}]\z")))
    line = lambda x: F.when(trim_blanks(x) == "", F.lit("")).otherwise(F.concat(F.lit(mark), trim_blanks(x), F.lit(mark)))
    return F.when(F.contains(text, F.lit("\n")), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(flat)


def fenced(text: Column) -> Column:
    """A fenced code block, or null for one without text."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, rf"[{BLANK_CLASS}]+\z", ""))
    body = F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", "")
    return F.when(body != "", F.concat(F.lit("```\n"), body, F.lit("\n```")))


def quoted(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def stands_alone(line: Column) -> Column:
    """Lines that are never filled: fences, indented and blank ones, headings, table rows, reference definitions and thematic breaks."""
    core = F.ltrim(line, F.lit(BLANK))
    return line.rlike(rf"{FENCE}|\A(?:    |\t)|\A[{BLANK_CLASS}]*(?:\z|[#|])") | core.rlike(REFERENCE) | core.rlike(BREAK)


def fill_line(line: Column, width: Column) -> Column:
    """A line broken between tokens so that its rows keep to the width where they can.

    One pass over the tokens' widths notes with which tokens rows begin: a fold whose state is the number of tokens so far, the column, and
    these places, which are copied only when a row ends. Further rows repeat the quote marks and stand under the item's text. A token
    wider than a row stays where it is, as it would not fit on the next one either.
    """
    part = lambda i: F.regexp_extract(line, MARKS, i)
    marks = F.struct(F.concat(part(1), part(2), part(3)).alias("first"), F.concat(part(1), part(2), F.repeat(F.lit(" "), F.length(part(3)))).alias("further"))

    def step(acc: Column, size: Column, further: Column) -> Column:
        over = (acc["n"] > 0) & (acc["col"] + 1 + size > width) & (size <= width)
        col = F.when(acc["n"] == 0, acc["col"] + size).when(over, further + size).otherwise(acc["col"] + 1 + size)
        return F.struct((acc["n"] + 1).alias("n"), col.alias("col"), F.when(over, F.concat(acc["begins"], F.array(acc["n"]))).otherwise(acc["begins"]).alias("begins"))

    def rows(m: Column, tokens: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.length(m["first"]).alias("col"), F.array(F.lit(0)).alias("begins"))
        begins = F.aggregate(F.transform(tokens, visible_width), begin, lambda acc, size: step(acc, size, F.length(m["further"])), lambda acc: F.concat(acc["begins"], F.array(F.size(tokens))))
        row = lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda low, high: F.array_join(F.slice(tokens, low + 1, high - low), " "))
        return F.concat(m["first"], F.call_function("array_join", let(begins, row), F.concat(F.lit("\n"), m["further"])))

    def filled(m: Column) -> Column:
        tokens = F.regexp_extract_all(F.substr(line, F.length(m["first"]) + 1), F.lit(TOKEN), F.lit(0))
        return let(tokens, lambda t: F.when(F.size(t) == 0, line).otherwise(rows(m, t)))

    return let(marks, filled)


def wrap_lines(text: Column, width: int | Column = 80) -> Column:
    """The text with its lines filled to a visible width. A fence and all up to its end is one piece, which is kept as it is."""
    width = F.lit(width) if isinstance(width, int) else width
    pieces = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(FENCED_OR_LINE), F.lit(0))
    line = lambda piece: let(F.substr(piece, F.lit(2)), lambda x: F.when(stands_alone(x), x).otherwise(fill_line(x, width)))
    return F.array_join(F.transform(pieces, line), "\n")


def wrap_width(option: Column, default: int = 80) -> Column:
    """A line width from 40 to 240 given as a string, else the default."""
    n = F.when(option.rlike(r"\A\+?[0-9]+\z"), option.try_cast("int"))
    return F.coalesce(F.when(n.between(40, 240), n), F.lit(default))


def render_link(label: Column, href: Column, raw: Column) -> Column:
    """A link in Markdown from its rendered label, its target and its raw text."""
    text, target = one_line(label), F.coalesce(href, F.lit(""))
    bare = lambda x: F.regexp_replace(x, r"/+\z", "")
    shown = F.when(F.contains(text, F.lit("](")), one_line(raw)).otherwise(text)
    return (
        F.when((text == "") | is_glyph(text), F.lit(""))
        .when((target == "") | target.rlike(rf"[{BLANK_CLASS}<>]") | (bare(text) == bare(target)), text)
        .when(shown == "", F.lit(""))
        .otherwise(F.concat(F.lit("["), shown, F.lit("]("), target, F.lit(")")))
    )
