"""The Markdown blocks of whole pages from their nodes, without a tree.

What contains blocks, and what is rendered whole, follows from flags of each node. The children of what contains blocks are found by one
running maximum over the document, at all levels at once; neighbouring inline ones of a parent are an island and make one paragraph. Quotes
put their marks before the lines of all blocks in them, as often as they lie in each other. Lists and tables are rendered from their items and cells.
Everything is grouped and sorted within a document or less, and nothing makes pairs of ancestors and nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..kernel.chars import PARAGRAPHS
from ..sources.files import release, settled
from . import blocks as B
from .inline import below, inline_markdown
from .nodes import DOC, block_flags, document_order, min_heading_level, nearest_table, normalise_text, subtree_text, visible

LISTS = ("ul", "ol")


def cleaned(nodes: DataFrame) -> DataFrame:
    """The nodes that show, their texts without invisible characters, those in links on one line."""
    seen = normalise_text(visible(nodes))
    reach = F.max(F.when(F.col("name") == "a", F.col("last_desc"))).over(document_order().rowsBetween(W.unboundedPreceding, 0))
    rows = seen.select(F.struct("*").alias("row"), F.coalesce(reach >= F.col("node_id"), F.lit(False)).alias("linked"))
    text = F.when(F.col("linked"), X.flatten_link_text(F.col("row.text"))).otherwise(F.col("row.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in nodes.columns))


def body_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, body, body_end): the first body of each document, or its root."""
    place = F.struct("node_id", "last_desc")
    return nodes.groupBy(DOC).agg(F.coalesce(F.min(F.when(F.col("name") == "body", place)), F.min(place)).alias("b")).select(DOC, F.col("b.node_id").alias("body"), F.col("b.last_desc").alias("body_end"))


def parts(nodes: DataFrame) -> DataFrame:
    """The nodes that are rendered whole, with `run`: what shares a parent and a run makes one block; is_block, quotes around it, and quotes shared with what comes before.

    A node counts if no other one above it, up to the body, is rendered whole.
    """
    flags = block_flags(nodes).select(DOC, "node_id", "block_child", "block_below")
    n = nodes.where("kind in ('element', 'text')").join(flags, [DOC, "node_id"], "left").join(body_of(nodes), DOC).where("node_id > body and node_id <= body_end")
    name, holds = F.coalesce("name", F.lit("")), F.coalesce("block_below", F.lit(False))
    opened = (
        F.when(name.isin(*PARAGRAPHS), F.coalesce("block_child", F.lit(False)))
        .when(name.isin("hr", "pre", "table", *LISTS) | X.heading_level(name).isNotNull(), False)
        .when(name == "blockquote", True)
        .otherwise(holds)
    )
    n = n.select(DOC, "node_id", "parent_id", "last_desc", "name", opened.alias("opened"), (X.is_block(name) | holds).alias("is_block"), (name == "blockquote").alias("quote"))
    closed = F.max(F.when(~F.col("opened"), F.col("last_desc"))).over(document_order().rowsBetween(W.unboundedPreceding, -1))
    n = n.withColumn("closed", closed).where(F.coalesce(F.col("closed") < F.col("node_id"), F.lit(True)))
    n = n.withColumn("run", F.sum(F.col("is_block").cast("int")).over(W.partitionBy(DOC, "parent_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)))
    ends = n.where("quote").select(DOC, F.col("last_desc").alias("at"), F.lit(1).alias("turn"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("whole"))
    events = n.select(DOC, F.col("node_id").alias("at"), F.lit(0).alias("turn"), F.col("quote").cast("int").alias("step"), F.when(~F.col("opened"), F.col("node_id")).alias("whole")).unionByName(ends)
    upto = W.partitionBy(DOC).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumns({"quotes": F.sum("step").over(upto), "before": F.count("whole").over(upto.rowsBetween(W.unboundedPreceding, -1))})
    # Between two neighbours the least number of open quotes is what they share.
    depth = events.groupBy(DOC, "before").agg(F.max("whole").alias("node_id"), F.max_by("quotes", F.col("whole").isNotNull()).alias("quotes"), F.min("quotes").alias("low")).where("node_id is not null")
    last = F.lag("quotes", 1, 0).over(W.partitionBy(DOC).orderBy("node_id"))
    depth = depth.select(DOC, "node_id", "quotes", F.least("low", last).alias("shared"))
    return n.where("not opened").drop("opened", "quote", "closed").join(depth, [DOC, "node_id"])


def list_parts(nodes: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, contents) of the chosen lists and of lists in their items: (doc_id, top, node_id, ordered, n, level, nests) and (doc_id, parent_id, node_id, name).

    An item counts in each list, whether it has text or not. What stands in a list outside items is left out.
    """
    marked = nodes.join(lists.select(DOC, "node_id", F.lit(True).alias("chosen")), [DOC, "node_id"], "left")
    n = below(marked, F.col("chosen"), F.col("parent_id"), F.col("depth"))
    up = nodes.where(F.col("name").isin("li", *LISTS)).select(DOC, F.col("node_id").alias("parent_id"), F.col("name").alias("parent_name"))
    n = n.join(up, [DOC, "parent_id"], "left").withColumn("parent_name", F.when(F.col("node_id") != F.col("top"), F.coalesce("parent_name", F.lit(""))))
    is_list = F.coalesce(F.col("name").isin(*LISTS) & (F.col("parent_name").isNull() | (F.col("parent_name") == "li")), F.lit(False))
    is_item = F.coalesce((F.col("name") == "li") & F.col("parent_name").isin(*LISTS), F.lit(False))
    inside = W.partitionBy(DOC, "top")
    n = n.withColumns({"is_list": is_list, "is_item": is_item})
    closed = F.max(F.when(~F.col("is_list") & ~F.col("is_item"), F.col("last_desc"))).over(inside.orderBy("node_id").rowsBetween(W.unboundedPreceding, -1))
    n = n.withColumns({"closed": closed, "base": F.min("depth").over(inside)}).where(F.coalesce(F.col("closed") < F.col("node_id"), F.lit(True)))
    nests = n.where("is_list and node_id <> top").select(DOC, F.col("parent_id").alias("node_id"), F.lit(True).alias("nests")).distinct()
    items = n.where("is_item").withColumn("n", F.row_number().over(W.partitionBy(DOC, "parent_id").orderBy("node_id"))).join(nests, [DOC, "node_id"], "left")
    level = ((F.col("depth") - F.col("base") - 1) / 2).cast("int")
    items = items.select(DOC, "top", "node_id", (F.col("parent_name") == "ol").alias("ordered"), "n", level.alias("level"), F.coalesce("nests", F.lit(False)).alias("nests"))
    return items, n.where("not is_list and not is_item and parent_name = 'li'").select(DOC, "parent_id", "node_id", "name")


def list_texts(items: DataFrame, contents: DataFrame, markdown: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of each chosen list: a line for each item that has text or a list."""
    part = F.when(X.is_cell_block(F.coalesce("name", F.lit(""))), X.trim_blanks(F.col("markdown"))).otherwise(F.col("markdown"))
    told = contents.join(markdown, [DOC, "node_id"]).groupBy(DOC, F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", part.alias("part")))).alias("run"))
    told = told.select(DOC, "node_id", X.one_line(F.array_join(F.transform("run", lambda x: x["part"]), "")).alias("item"))
    full = items.join(told, [DOC, "node_id"], "left").withColumn("item", F.coalesce("item", F.lit(""))).where("item <> '' or nests")
    mark = F.when(F.col("ordered"), F.concat(F.col("n").cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    lines = full.select(DOC, "top", "node_id", F.concat(F.repeat(F.lit("  "), F.col("level")), mark, "item").alias("line"))
    run = F.array_sort(F.collect_list(F.struct("node_id", "line")))
    return lines.groupBy(DOC, F.col("top").alias("node_id")).agg(F.array_join(F.transform(run, lambda x: x["line"]), "\n").alias("text"))


def cell_parts(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, node_id) of the chosen tables' own cells; a row without cells has one without a node."""
    rows = nearest_table(nodes, ("tr",)).join(tables.select(DOC, F.col("node_id").alias("table_id")), [DOC, "table_id"], "left_semi")
    rows = rows.select(DOC, "table_id", F.col("node_id").alias("parent_id"), (F.row_number().over(W.partitionBy(DOC, "table_id").orderBy("node_id")) - 1).alias("row"))
    cells = rows.join(nodes.where("name in ('td', 'th')").select(DOC, "parent_id", "node_id"), [DOC, "parent_id"], "left")
    cells = cells.withColumn("any", F.count("node_id").over(W.partitionBy(DOC, "table_id"))).where("any > 0")
    return cells.select(DOC, "table_id", "row", (F.row_number().over(W.partitionBy(DOC, "table_id", "row").orderBy("node_id")) - 1).alias("col"), "node_id")


def quoted_runs(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, block) of (doc_id, node_id, block, quotes, shared): blocks in quotes are put together, with a mark for each quote around each line."""
    order = W.partitionBy(DOC).orderBy("node_id")
    kept = blocks.withColumn("before", F.count("block").over(order.rowsBetween(W.unboundedPreceding, -1)))
    kept = kept.withColumn("shared", F.min("shared").over(W.partitionBy(DOC, "before"))).where("block is not null")
    mark = lambda n: F.repeat(F.lit("> "), n)
    lines = F.transform(F.split("block", "\r?\n"), lambda x: F.when(x == "", F.rtrim(mark(F.col("quotes")))).otherwise(F.concat(mark(F.col("quotes")), x)))
    told = F.when(F.col("quotes") == 0, F.col("block")).otherwise(F.array_join(lines, "\n"))
    told = F.when(F.col("shared") > 0, F.concat(F.rtrim(mark(F.col("shared"))), F.lit("\n"), told)).otherwise(told)
    kept = kept.select(DOC, "node_id", told.alias("told"), F.sum((F.col("shared") == 0).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("pos"))
    run = F.array_sort(F.collect_list(F.struct("node_id", "told")))
    return kept.groupBy(DOC, (F.col("pos") - 1).alias("pos")).agg(F.array_join(F.transform(run, lambda x: x["told"]), "\n").alias("block"))


def page_blocks(nodes: DataFrame) -> DataFrame:
    """(doc_id, pos, block) of each document: its Markdown before the steps that look at several blocks; nodes: cleaned(...), best written.

    Layout tables, vendor markup and the like are rendered as they stand; rewrite the nodes first where they are to go. A document without
    blocks has no rows.
    """
    found = settled(parts(nodes), "parts")
    lists, tables = found.where(F.col("name").isin(*LISTS)), found.where("name = 'table'")
    items, contents = list_parts(nodes, lists)
    contents = settled(contents, "contents")
    cells = settled(cell_parts(nodes, tables), "cells")
    inline = found.where(F.coalesce(~F.col("name").isin("hr", "pre", "table", *LISTS), F.lit(True)))
    tops = inline.select(DOC, "node_id").unionByName(contents.select(DOC, "node_id")).unionByName(cells.where("node_id is not null").select(DOC, "node_id"))
    marked = nodes.join(tops.withColumn("chosen", F.lit(True)), [DOC, "node_id"], "left")
    markdown = settled(inline_markdown(marked, F.col("chosen")), "inline")

    listed = list_texts(items, contents, markdown)
    tabled = cells.join(markdown, [DOC, "node_id"], "left").select(DOC, "table_id", "row", "col", F.coalesce("markdown", F.lit("")).alias("cell"))
    tabled = B.pipe_tables(tabled).select(DOC, F.col("table_id").alias("node_id"), "text")
    code = subtree_text(nodes, F.col("name") == "pre").select(DOC, "node_id", X.fenced(F.col("subtree_text")).alias("text"))
    told = listed.unionByName(tabled).unionByName(code)

    shift = min_heading_level(nodes).select(DOC, (F.col("min_level") - 1).cast("int").alias("shift"))
    whole = found.join(markdown, [DOC, "node_id"], "left").join(told, [DOC, "node_id"], "left").join(shift, DOC)
    run = F.array_sort(F.collect_list(F.struct("node_id", F.coalesce("markdown", F.lit("")).alias("part"))))
    first = lambda c: F.min_by(c, "node_id").alias(c)
    whole = whole.groupBy(DOC, "parent_id", "run", "is_block").agg(F.min("node_id").alias("node_id"), first("name"), first("text"), first("shift"), first("quotes"), F.min("shared").alias("shared"), F.array_join(F.transform(run, lambda x: x["part"]), "").alias("md"))
    level, head = X.heading_level(F.col("name")), X.trim_blanks(F.replace("md", F.lit("\n"), F.lit(" ")))
    is_block, name = F.col("is_block"), F.col("name")
    block = (
        F.when(is_block & level.isNotNull(), F.when(head != "", X.heading_block(level, F.col("shift"), head)))
        .when(is_block & (name == "hr"), F.lit("---"))
        .when(is_block & name.isin("pre", "table", *LISTS), F.col("text"))
        .otherwise(X.tidy_inline(F.col("md")))
    )
    out = settled(quoted_runs(whole.select(DOC, "node_id", F.when(block != "", block).alias("block"), "quotes", "shared")), "blocks")
    release(found, contents, cells, markdown)
    return out
