"""From HTML to Markdown in one pass over the rows, without a shuffle.

Python does what needs a mutable tree, the blocks of a page. All after it is native: the steps that look at several blocks, and
the filling of lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel import convert
from . import text as X

IE = re.compile(X.IE_CONDITIONAL)
NODE = "struct<node_id:int,parent_id:int,last_desc:int,depth:int,ord:int,kind:string,name:string,attrs:map<string,string>,text:string>"


def page_blocks(html: Column, permissive: bool = False) -> Column:
    """The blocks of a page as array<string>; null for null. permissive: a page that fails gives null instead of an error."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def blocks(pages: pa.Array) -> pa.Array:
        def one(page: str | None) -> list[str] | None:
            try:
                return None if page is None else convert.blocks(page)
            except Exception:
                if not permissive:
                    raise
                return None

        return pa.array(map(one, pages.to_pylist()), pa.list_(pa.string()))

    return blocks(X.strip_ie_conditionals(html))


FIELDS = ("node_id", "parent_id", "last_desc", "depth", "ord", "kind", "name", "attrs", "text")
KINDS = (*[pa.int32()] * 5, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
NODES_AT_ONCE = 4096


def node_arrays(rows: list[tuple], fields: Iterable[int]) -> list[pa.Array]:
    """Some fields of nodes as columns."""

    def one(i: int) -> pa.Array:
        if FIELDS[i] != "attrs":
            return pa.array([r[i] for r in rows], KINDS[i])
        ends = list(accumulate((len(r[i] or ()) for r in rows), initial=0))
        starts = [None if r[i] is None else at for r, at in zip(rows, ends)]
        held = [r[i] for r in rows if r[i]]
        return pa.MapArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), pa.array([k for a in held for k in a], pa.string()), pa.array([v for a in held for v in a.values()], pa.string()))

    return [one(i) for i in fields]


def nodes_of(pages: pa.Array, names: frozenset[str] | None, fields: Iterable[int]) -> pa.Array:
    """The nodes of each page. Few are held as Python objects at once: they become columns as they are read, whatever the number of pages."""
    ends, done, rows, parts = [], 0, [], []

    def flush() -> None:
        nonlocal done
        done += len(rows)
        parts.append(pa.StructArray.from_arrays(node_arrays(rows, fields), [FIELDS[i] for i in fields]))
        rows.clear()

    for page in pages:
        text = page.as_py()
        ends.append(done + len(rows))
        if text is not None:
            rows += convert.nodes(text, names)
            if len(rows) >= NODES_AT_ONCE:
                flush()
    flush()
    return pa.ListArray.from_arrays(pa.array([*ends, done], pa.int32()), pa.concat_arrays(parts), mask=pages.is_null())


def node_rows(fields: Iterable[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, html): a row for each node, one of nulls for a null page. Nodes leave as they are read, so a task holds few, whatever the size of its batches."""
    kept = [i for i, f in enumerate(FIELDS) if f in set(fields)]
    null_node = (None,) * len(FIELDS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, of, found = batch.column(0), [], []
            for i, page in enumerate(batch.column(1)):
                text = page.as_py()
                own = [null_node] if text is None else convert.nodes(text)
                for at in range(0, len(own), NODES_AT_ONCE):
                    found += own[at : at + NODES_AT_ONCE]
                    of += [i] * (len(found) - len(of))
                    if len(found) >= NODES_AT_ONCE:
                        yield node_batch(keys, of, found)
                        of, found = [], []
            if found:
                yield node_batch(keys, of, found)

    def node_batch(keys: pa.Array, of: list[int], found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int64())), *node_arrays(found, kept)], ["doc_id", *(FIELDS[k] for k in kept)])

    return rows


def kind_of(fields: Iterable[str]) -> list[str]:
    """The fields of a node with their types, as name:type."""
    kinds = NODE.removeprefix("struct<").removesuffix(">").replace("map<string,string>", "map<string;string>").split(",")
    return [k.replace(";", ",") for f, k in zip(FIELDS, kinds, strict=True) if f in set(fields)]


def page_nodes(html: Column, names: Iterable[str] | None = None, fields: Iterable[str] = FIELDS) -> Column:
    """The nodes of a page as an array of structs, for exploding into the table of nodes; names: only elements of these."""
    kept = [i for i, f in enumerate(FIELDS) if f in set(fields)]
    wanted = None if names is None else frozenset(names)
    kind = ",".join(kind_of(fields))

    @F.arrow_udf(T._parse_datatype_string(f"array<struct<{kind}>>"))
    def nodes(pages: pa.Array) -> pa.Array:
        return nodes_of(pages, wanted, kept)

    return nodes(X.strip_ie_conditionals(html))


# In the next functions a lambda refers to nothing but its own arguments: with an outer variable in it, Spark does not
# evaluate a Python function of the result.


def drop_empty_sections(blocks: Column) -> Column:
    """Without the headings that a heading of the same or a higher level follows."""
    following = F.slice(blocks, F.lit(2), F.greatest(F.lit(1), F.size(blocks)))
    judged = F.zip_with(blocks, following, lambda b, n: F.struct(b.alias("b"), F.coalesce(X.block_level(n) > X.block_level(b), F.lit(True)).alias("keep")))
    return F.transform(F.filter(judged, lambda x: x["keep"]), lambda x: x["b"])


def compress_levels(blocks: Column) -> Column:
    """Heading levels as ranks of the levels in use, if there are two or more."""
    used = F.filter(F.array_sort(F.array_distinct(F.transform(blocks, X.block_level))), lambda x: x.isNotNull())

    def one(b: Column, levels: Column) -> Column:
        rank = F.array_position(levels, X.block_level(b)).cast("int")
        return F.when(X.block_level(b).isNull() | (F.size(levels) < 2), b).otherwise(F.concat(F.repeat(F.lit("#"), rank), F.regexp_replace(b, r"\A#*", "")))

    return F.zip_with(blocks, F.array_repeat(used, F.size(blocks)), one)


def join_link_rows(blocks: Column, width: int) -> Column:
    """Runs of short links on one line, where the whole run fits."""
    empty = F.array().cast("array<string>")

    def flushed(acc: Column) -> Column:
        line = F.array_join(acc["run"], " · ")
        return F.concat(acc["out"], F.when((F.size(acc["run"]) >= 2) & (X.visible_width(line) <= width), F.array(line)).otherwise(acc["run"]))

    def step(acc: Column, b: Column) -> Column:
        more = F.struct(acc["out"].alias("out"), F.concat(acc["run"], F.array(b)).alias("run"))
        other = F.struct(F.concat(flushed(acc), F.array(b)).alias("out"), empty.alias("run"))
        return F.when(X.is_short_link(b), more).otherwise(other)

    return F.aggregate(blocks, F.struct(empty.alias("out"), empty.alias("run")), step, flushed)


def html_to_markdown(html: Column, width: int = 80, permissive: bool = False) -> Column:
    """The Markdown of a page, wrapped at `width`; null for null."""
    if not 40 <= width <= 240:
        width = 80
    blocks = join_link_rows(compress_levels(drop_empty_sections(page_blocks(html, permissive))), width)
    text = X.collapse_blank_runs(F.array_join(blocks, "\n\n"))
    return F.regexp_replace(X.wrap_lines(text, width), r"\A\n+", "")


def register(spark) -> None:
    """Makes the engine known to SQL: the scalar html_to_markdown(html, width), and the table functions html_nodes(TABLE(...)) and html_blocks(TABLE(...)).

    The scalar takes a page at a time in Arrow batches; a null page or width gives null, a width out of range the default. The table functions read
    the columns `id` and `html` of the table that they are given, a batch at a time, and give its id with each node or block.
    """
    def columns_of(table: pa.RecordBatch, parts, names: tuple, kinds: tuple) -> pa.Table:
        """The id of each page beside what it gives."""
        found = [[] if page is None else list(parts(IE.sub("", page))) for page in table["html"].to_pylist()]
        ids = table["id"].take(pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64()))
        columns = list(zip(*(row for rows in found for row in rows), strict=True)) or [[]] * len(names)
        return pa.table([ids, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=["id", *names])

    @F.arrow_udtf(returnType="id long, " + NODE.removeprefix("struct<").removesuffix(">").replace(":", " "))
    class Nodes:
        def eval(self, table: pa.RecordBatch):
            yield columns_of(table, lambda page: ((*n[:7], list(n[7].items()), n[8]) for n in convert.nodes(page)), FIELDS, KINDS)

    @F.arrow_udtf(returnType="id long, pos int, block string")
    class Blocks:
        def eval(self, table: pa.RecordBatch):
            yield columns_of(table, lambda page: enumerate(convert.blocks(page)), ("pos", "block"), (pa.int32(), pa.string()))

    @F.arrow_udf(T.StringType())
    def scalar(pages: pa.Array, widths: pa.Array) -> pa.Array:
        both = zip(pages.to_pylist(), widths.to_pylist(), strict=True)
        return pa.array([None if page is None or width is None else convert.markdown(IE.sub("", page), width) for page, width in both], pa.string())

    spark.udf.register("html_to_markdown", scalar)
    spark.udtf.register("html_nodes", Nodes)
    spark.udtf.register("html_blocks", Blocks)
