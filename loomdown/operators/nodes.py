"""Operators on the table of nodes, where d lies below a if a.node_id < d.node_id <= a.last_desc.

Every window and join is within a document, and none makes pairs of ancestors and nodes. What lies below a node comes from
running counts in document order: the count at the end of the node less that at its beginning. The innermost table
above a node comes from how many tables are open there.

A page with null html has one node of null kind: it keeps its row where results are by document, and has none elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.markdown import FIELDS, kind_of, node_rows, page_nodes
from ..kernel.chars import EMPHASIS, HEADINGS

DOC = "doc_id"


def document_order():
    return W.partitionBy(DOC).orderBy("node_id")


def explode_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", names: tuple[str, ...] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """names: only the elements of these, with the numbers that they have among all nodes, and no rows for pages without one."""
    if names is not None:
        return pages.select(F.col(key).alias(DOC), F.explode(page_nodes(F.col(html), names, fields)).alias("n")).select(DOC, "n.*")
    rows = pages.select(F.col(key).alias(DOC), X.strip_ie_conditionals(F.col(html)).alias("html"))
    return rows.mapInArrow(node_rows(fields), ",".join((f"{DOC}:{rows.schema[DOC].dataType.simpleString()}", *kind_of(fields))))


def counted_below(nodes: DataFrame, wanted: Column, **marks: Column) -> DataFrame:
    """(doc_id, node_id, and for each mark its name and own_<name>): how many nodes below each chosen one hold it, and whether that one does.

    Counts run over the beginnings of nodes and the ends of the chosen ones, so that nodes below may be missing. Nodes that are neither chosen nor
    counted are left out before anything is moved, and the events of a node are made where it is, so that it is read and moved once.
    """
    wanted, marks = F.coalesce(wanted, F.lit(False)), {k: F.coalesce(m, F.lit(False)) for k, m in marks.items()}
    slim = nodes.select(DOC, "node_id", "last_desc", wanted.alias("wanted"), *(m.cast("int").alias(k) for k, m in marks.items()))
    slim = slim.where(" or ".join(["wanted", *(f"{k} > 0" for k in marks)]))
    place = nodes.schema["node_id"].dataType
    event = lambda at, turn, top, own: F.struct(at.cast(place).alias("at"), F.lit(turn).alias("turn"), top.alias("top"), *(x.alias(k) for k, x in own.items()))
    begin = event(F.col("node_id"), 0, F.when(F.col("wanted"), F.col("node_id")), {k: F.col(k) for k in marks})
    end = event(F.col("last_desc"), 1, F.col("node_id"), {k: F.lit(0) for k in marks})
    events = slim.select(DOC, F.explode(F.when(F.col("wanted"), F.array(begin, end)).otherwise(F.array(begin))).alias("e")).select(DOC, "e.*")
    upto = W.partitionBy(DOC).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    both = events.withColumns({f"run_{k}": F.sum(k).over(upto) for k in marks}).where("top is not null")
    return both.groupBy(DOC, F.col("top").alias("node_id")).agg(
        *(F.min(f"run_{k}").alias(f"from_{k}") for k in marks),
        *((F.max(f"run_{k}") - F.min(f"run_{k}")).alias(k) for k in marks),
        *((F.max(k) > 0).alias(f"own_{k}") for k in marks),
    )


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def drop_subtrees(nodes: DataFrame, victims: Column) -> DataFrame:
    """Without the nodes for which the condition holds and all below them."""
    row = F.struct("*")
    reach = F.max(F.when(victims, F.col("last_desc"))).over(document_order().rowsBetween(W.unboundedPreceding, 0))
    return nodes.select(row.alias("row"), reach.alias("reach")).where(F.coalesce(F.col("reach") < F.col("row.node_id"), F.lit(True))).select("row.*")


def visible(nodes: DataFrame) -> DataFrame:
    name = F.coalesce("name", F.lit(""))
    return drop_subtrees(nodes, (F.col("kind") == "comment") | X.is_namespaced(name) | X.hides(attribute("style")) | X.is_non_text(name))


def normalise_text(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("text", F.when(F.col("kind") == "text", X.clean_invisibles(F.col("text"))).otherwise(F.col("text")))


def subtree_text(nodes: DataFrame, wanted: Column, chunk: int = 64) -> DataFrame:
    """(doc_id, node_id, subtree_text) of the chosen elements.

    The texts that stand in a chosen element are numbered within their document and put into chunks, and each subtree meets those chunks alone that it
    reaches into, so that what is moved grows with the texts that are asked for.
    """
    slim = nodes.select(DOC, "node_id", "last_desc", (F.col("kind") == "text").alias("is_text"), F.coalesce(wanted, F.lit(False)).alias("wanted"), "text").where("is_text or wanted")
    reach = F.max(F.when(F.col("wanted"), F.col("last_desc"))).over(document_order().rowsBetween(W.unboundedPreceding, 0))
    slim = slim.withColumn("reach", reach).where("reach >= node_id")
    tops = counted_below(slim, F.col("wanted"), texts=F.col("is_text"))
    begin, end = F.col("from_texts"), F.col("from_texts") + F.col("texts")
    reach = F.when(F.col("texts") > 0, F.sequence(F.floor(begin / chunk), F.floor((end - 1) / chunk)))
    asked = tops.select(DOC, "node_id", begin.alias("begin"), end.alias("end"), F.explode_outer(reach).alias("chunk"))
    texts = slim.where("is_text").select(DOC, "text", (F.row_number().over(document_order()) - 1).cast("long").alias("n"))
    chunks = texts.groupBy(DOC, F.floor(F.col("n") / chunk).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("run"))
    low = F.greatest(F.col("begin") - F.col("chunk") * chunk, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("chunk") * chunk, F.lit(chunk)).cast("int")
    part = F.array_join(F.slice(F.coalesce("run", F.array().cast("array<string>")), F.coalesce(low, F.lit(0)) + 1, F.coalesce(high - low, F.lit(0))), "")
    met = asked.join(chunks, [DOC, "chunk"], "left").select(DOC, "node_id", F.struct("chunk", part.alias("part")).alias("p"))
    return met.groupBy(DOC, "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "").alias("subtree_text"))


def anchors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, href, text) of links that show something."""
    links = nodes.where("name = 'a'").select(DOC, "node_id", attribute("href").alias("href"))
    found = links.join(subtree_text(nodes, F.col("name") == "a"), [DOC, "node_id"]).withColumn("text", X.flatten_link_text(F.col("subtree_text")))
    core = X.trim_blanks(F.col("text"))
    return found.where((core != "") & ~X.is_glyph(core)).select(DOC, "node_id", "href", "text")


def stat_headings(nodes: DataFrame) -> DataFrame:
    """Headings that only show a figure."""
    core = X.trim_blanks(F.col("subtree_text"))
    return subtree_text(nodes, F.col("name").isin(*HEADINGS)).where(F.length(core).between(1, 12) & X.is_stat(core)).select(DOC, "node_id", core.alias("stat"))


def empty_emphasis(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, action) of emphasis that is blank ("drop") or up to three symbols ("unwrap")."""
    core = X.trim_blanks(F.col("subtree_text"))
    symbols = (F.length(core) <= 3) & ~core.rlike(r"[\p{IsAlphabetic}\p{N}\s]")
    action = F.when(core == "", F.lit("drop")).when(symbols, F.lit("unwrap"))
    return subtree_text(nodes, F.col("name").isin(*sorted(EMPHASIS))).select(DOC, "node_id", action.alias("action")).where("action is not null")


def min_heading_level(nodes: DataFrame) -> DataFrame:
    """(doc_id, min_level) over headings with text; 7 without one.

    A heading has text if it has texts below it that are not blank, so no text is gathered.
    """
    level = X.heading_level(F.col("name"))
    full = (F.col("kind") == "text") & (X.trim_blanks(F.col("text")) != "")
    heads = counted_below(nodes, level.isNotNull(), texts=full, **{f"h{i}": level == i for i in range(1, 7)}).where("texts > 0")
    own = F.coalesce(*(F.when(F.col(f"own_h{i}"), i) for i in range(1, 7)))
    lows = heads.groupBy(DOC).agg(F.min(own).alias("low"))
    return nodes.select(DOC).distinct().join(lows, DOC, "left").select(DOC, F.coalesce("low", F.lit(7)).cast("long").alias("min_level"))


def flex_rows(nodes: DataFrame) -> DataFrame:
    """Outermost flex divs with two to eight elements as children."""
    flex = nodes.withColumn("flex", (F.coalesce("name", F.lit("")) == "div") & X.is_flex(attribute("style")))
    before = F.max(F.when(F.col("flex"), F.col("last_desc"))).over(document_order().rowsBetween(W.unboundedPreceding, -1))
    outer = flex.withColumn("before", before).where(F.col("flex") & F.coalesce(F.col("before") < F.col("node_id"), F.lit(True))).select(DOC, "node_id")
    kids = nodes.where("kind = 'element'").groupBy(DOC, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_kids"))
    return outer.join(kids, [DOC, "node_id"]).where(F.col("n_kids").between(2, 8))


def block_flags(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, block_child, block_below, break_below) of elements that have one of them."""
    is_block = X.is_block(F.col("name"))
    kids = nodes.where(is_block & F.col("parent_id").isNotNull()).select(DOC, F.col("parent_id").alias("node_id")).distinct().withColumn("block_child", F.lit(True))
    tops = counted_below(nodes, F.col("kind") == "element", blocks=is_block, breaks=F.col("name") == "br").join(kids, [DOC, "node_id"], "left")
    found = tops.select(DOC, "node_id", F.coalesce("block_child", F.lit(False)).alias("block_child"), (F.col("blocks") > 0).alias("block_below"), (F.col("breaks") > 0).alias("break_below"))
    return found.where("block_child or block_below or break_below")


def subtree_has_break(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, has_break) of every element: whether it is a br or holds one."""
    tops = counted_below(nodes, F.col("kind") == "element", breaks=F.col("name") == "br")
    return tops.select(DOC, "node_id", (F.col("own_breaks") | (F.col("breaks") > 0)).alias("has_break"))


def short_paragraphs(nodes: DataFrame, most: int = 60) -> DataFrame:
    """(doc_id, node_id, text) of paragraphs with one to `most` characters and neither blocks nor line breaks below them."""
    is_paragraph = F.coalesce(F.col("name") == "p", F.lit(False))
    plain = counted_below(nodes, is_paragraph, blocks=X.is_block(F.col("name")), breaks=F.col("name") == "br").where("blocks = 0 and breaks = 0").select(DOC, "node_id")
    text = subtree_text(nodes, is_paragraph).select(DOC, "node_id", X.trim_blanks(F.col("subtree_text")).alias("text"))
    return text.where(F.length("text").between(1, most)).join(plain, [DOC, "node_id"], "left_semi")


def deepest_first(nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, node_id, turn) of the elements of a name: those further down come first, others in document order."""
    turn = F.row_number().over(W.partitionBy(DOC).orderBy(F.desc("depth"), "node_id"))
    return nodes.where(F.col("name") == name).select(DOC, "node_id", turn.alias("turn"))


def first_body(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id): the first body of each document, or its root where it has none."""
    body = F.min(F.when(F.col("name") == "body", F.col("node_id")))
    return nodes.groupBy(DOC).agg(F.coalesce(body, F.min("node_id")).alias("node_id"))


def inline_runs(nodes: DataFrame, parents: Column) -> DataFrame:
    """(doc_id, parent_id, run, text): neighbouring children of the chosen parents that neither are blocks nor hold any, with their text.

    Islands of siblings: each block ends one. Runs without text are left out.
    """
    tops = nodes.where(parents).select(DOC, F.col("node_id").alias("parent_id"))
    is_block = F.coalesce(X.is_block(F.col("name")), F.lit(False))
    kids = nodes.where("kind in ('element', 'text')").join(tops, [DOC, "parent_id"]).select(DOC, "parent_id", "node_id", "kind", "text", is_block.alias("is_block"))
    below = counted_below(nodes, F.col("kind") == "element", blocks=is_block).where("blocks > 0").select(DOC, "node_id", F.lit(True).alias("holds"))
    texts = subtree_text(nodes, (F.col("kind") == "element") & ~is_block)
    kids = kids.join(below, [DOC, "node_id"], "left").join(texts, [DOC, "node_id"], "left").withColumn("block", F.col("is_block") | F.coalesce("holds", F.lit(False)))
    run = F.sum(F.col("block").cast("int")).over(W.partitionBy(DOC, "parent_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0))
    kids = kids.withColumn("run", run).where("not block")
    parts = F.array_sort(F.collect_list(F.struct("node_id", F.coalesce("subtree_text", "text", F.lit("")).alias("text"))))
    joined = kids.groupBy(DOC, "parent_id", "run").agg(X.tidy_inline(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("text"))
    return joined.where("text <> ''")


def nearest_table(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, node_id, name, table_id): the innermost table above each element of these names.

    How many tables are open at a place is a running sum of their beginnings and ends. The innermost one is the last that began
    with that many open.
    """
    is_asked = F.col("name").isin(*names)
    slim = nodes.where(F.col("name").isin("table", *names)).select(DOC, "node_id", "last_desc", "name")
    return table_events(slim, F.when(is_asked, F.lit(1))).where("turn = 1 and open > 0").select(DOC, "node_id", "name", "table_id")


def table_events(slim: DataFrame, asks: Column, *columns: str) -> DataFrame:
    """(doc_id, node_id, name, turn, open, table_id, and the columns): a row with turn 1 for each node for which `asks` is not null, with turn 2 for each table.

    The first has the innermost table above the node, the other the table itself. The nodes are read once.
    """
    is_table = F.col("name") == "table"
    event = lambda at, turn, step: F.struct(at.cast("long").alias("at"), F.lit(turn).alias("turn"), F.lit(step).alias("step"))
    # Of what happens at one place, ends come first; a table asks for the one above it before it opens.
    own = F.when(asks.isNotNull(), F.array(event(F.col("node_id"), 1, 0))).otherwise(F.array().cast("array<struct<at:bigint,turn:int,step:int>>"))
    both = F.when(is_table, F.concat(own, F.array(event(F.col("node_id"), 2, 1), event(F.col("last_desc") + 1, 0, -1)))).otherwise(own)
    order = ("at", "turn", "node_id")
    events = slim.select(DOC, "node_id", "name", *columns, F.explode(both).alias("e")).select(DOC, "node_id", "name", *columns, "e.*")
    events = events.withColumn("open", F.sum("step").over(W.partitionBy(DOC).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where("turn > 0")
    last = F.last(F.when(F.col("turn") == 2, F.col("node_id")), ignorenulls=True).over(W.partitionBy(DOC, "open").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("table_id", last)


def data_tables(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, n_rows, min_cells, max_cells, is_data) of every table: its own rows, not those of tables in it."""
    is_cell = F.col("name").isin("td", "th")
    slim = nodes.where(F.col("name").isin("table", "tr", "thead", "caption", "td", "th")).select(DOC, "node_id", "last_desc", "name", F.when(is_cell, F.col("parent_id")).otherwise(F.col("node_id")).alias("holder"), attribute("role").alias("role"), attribute("border").alias("border"))
    # Cells are counted at their row.
    alike = W.partitionBy(DOC).orderBy("holder").rangeBetween(W.currentRow, W.currentRow)
    slim = slim.withColumn("n_cells", F.count_if(is_cell).over(alike)).where(~is_cell)
    is_own = F.col("turn") == 1
    is_row, itself = is_own & (F.col("name") == "tr"), F.col("turn") == 2
    df = table_events(slim, F.lit(1), "n_cells", "role", "border").where("table_id is not null and open > 0").groupBy(DOC, "table_id").agg(
        F.count_if(is_row).alias("n_rows"), F.coalesce(F.min(F.when(is_row, F.col("n_cells"))), F.lit(0)).alias("min_cells"), F.coalesce(F.max(F.when(is_row, F.col("n_cells"))), F.lit(0)).alias("max_cells"),
        F.bool_or(is_own & F.col("name").isin("thead", "caption")).alias("headed"), F.bool_or(is_own & (F.col("name") == "table")).alias("nests"),
        F.max(F.when(itself, F.col("role"))).alias("role"), F.max(F.when(itself, F.col("border"))).alias("border"),
    )
    return df.select(DOC, "table_id", "n_rows", "min_cells", "max_cells", is_data_table().alias("is_data"))


def is_data_table() -> Column:
    """The rules in order, over role, headed, nests, n_rows, min_cells, max_cells and border."""
    border = F.coalesce("border", F.lit(""))
    number = F.when(border.rlike(r"\A[+-]?[0-9]+\z"), border.try_cast("int"))
    bordered = F.when(number.isNotNull(), number > 0).otherwise(border != "")
    role = F.lower(X.trim_blanks(F.coalesce("role", F.lit(""))))
    return (
        F.when(role.isin("presentation", "none"), False)
        .when(F.col("headed"), True)
        .when(F.col("nests") | (F.col("n_rows") < 2) | (F.col("max_cells") < 2), False)
        .otherwise((F.col("min_cells") == F.col("max_cells")) & bordered)
    )


CELL_FIELDS = ("node_id", "parent_id", "last_desc", "kind", "name", "text")


def table_cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, cell) with each cell's text on one line."""
    rows = nearest_table(nodes, ("tr",)).withColumn("row", F.row_number().over(W.partitionBy(DOC, "table_id").orderBy("node_id")) - 1)
    cells = nodes.where("name in ('td', 'th')").select(DOC, F.col("node_id").alias("cell_id"), F.col("parent_id").alias("node_id"))
    cells = rows.join(cells, [DOC, "node_id"]).withColumn("col", F.row_number().over(W.partitionBy(DOC, "table_id", "row").orderBy("cell_id")) - 1)
    text = subtree_text(nodes, F.col("name").isin("td", "th")).select(DOC, F.col("node_id").alias("cell_id"), X.one_line(F.col("subtree_text")).alias("cell"))
    return cells.join(text, [DOC, "cell_id"]).select(DOC, "table_id", "row", "col", "cell")
